"""Similarity over vectors: exact search of a query set in blocks, links, best matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.functions.vectors import cosine, literal

#: Queries that are sent to all tasks at once; at 1,000 dimensions these are 32 MB. More are dealt out in blocks of about so many.
BLOCK = 4096
#: Rows of the base that one task compares with a block of queries where both are dealt out.
STRIPE = 16_384


def _unit(rows: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and which of them are usable: of the width, finite, not zero."""
    width = width if width is not None else (max(map(len, rows)) if rows else 0)
    usable = np.array([r is not None and len(r) == width and None not in r for r in rows], bool)
    matrix = np.zeros((len(rows), width))
    for i in np.flatnonzero(usable):
        matrix[i] = rows[i]
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable &= np.isfinite(norms) & (norms > 0)
    return np.where(usable[:, None], matrix / np.where(usable, norms, 1)[:, None], 0.0), usable


def _over_blocks(base: DataFrame, queries: DataFrame, id_column: str, vector: str, work, schema: str) -> DataFrame:
    """The results of work(ids, unit queries, base ids, unit base) → columns, for all queries against all rows of base.

    Up to BLOCK queries, which are counted, are broadcast and base isn't moved. More are dealt out: each block
    of queries meets each stripe of base in a task of its own, so neither side goes through the driver, and the work of a
    task is bounded.
    """
    plain = lambda df: df.select(F.col(id_column).cast("bigint").alias("i"), F.col(vector).alias("v")).filter("i is not null and v is not null")
    rows, wanted = plain(base), plain(queries)
    n, width = wanted.agg(F.count("*"), F.max(F.size("v"))).first()
    if n <= BLOCK:
        held = wanted.collect()
        units, usable = _unit([r.v for r in held], width or 0)
        shared = base.sparkSession.sparkContext.broadcast((np.array([r.i for r in held], np.int64)[usable], units[usable]))

        def run(batches):
            who, unit = shared.value
            for batch in batches:
                base_unit, fine = _unit(batch.column(1).to_pylist(), unit.shape[1])
                yield work(who, unit, batch.column(0).to_numpy()[fine], base_unit[fine])

        return rows.mapInArrow(run, schema)
    blocks, stripes = -(-n // BLOCK), max(1, -(-rows.count() // STRIPE))
    part = lambda of: F.pmod(F.xxhash64("i"), F.lit(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = wanted.select(F.lit(True).alias("q"), "i", "v", part(blocks).alias("block"), all_of(stripes).alias("stripe"))
    dealt = dealt.unionByName(rows.select(F.lit(False).alias("q"), "i", "v", all_of(blocks).alias("block"), part(stripes).alias("stripe")))

    def meet(table: pa.Table) -> pa.Table:
        units, fine = _unit(table.column("v").to_pylist(), width)
        of_query = table.column("q").to_numpy()
        ids = table.column("i").to_numpy()
        a, b = of_query & fine, ~of_query & fine
        return pa.Table.from_batches([work(ids[a], units[a], ids[b], units[b])])

    return dealt.groupBy("block", "stripe").applyInArrow(meet, schema)


def nearest(base: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """query_id, id, similarity (6 decimals), place: the k most similar rows of each query, itself excluded; ties by id.

    Exact: each block of queries is compared with all rows, every task keeps k for each query and only
    those are ranked. Vectors that are zero, not finite or of another length match nothing.
    """

    def work(who, unit, ids, rows):
        similarity = np.round(np.clip(unit @ rows.T, -1, 1), 6)
        picked_q, picked_i, picked_s = [], [], []
        for q in range(len(who)):
            s = similarity[q].copy()
            s[ids == who[q]] = -2
            if least is not None:
                s[s < least] = -2
            order = np.lexsort((ids, -s))[:k]
            order = order[s[order] > -2]
            picked_q.append(np.full(len(order), who[q]))
            picked_i.append(ids[order])
            picked_s.append(s[order])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.RecordBatch.from_arrays([join(picked_q, pa.int64()), join(picked_i, pa.int64()), join(picked_s, pa.float64())], names=["query_id", "id", "similarity"])

    found = _over_blocks(base, queries, id_column, vector, work, "query_id bigint, id bigint, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", rank).filter(F.col("place") <= k)


def link_counts(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, links: with how many other rows each row's cosine is over the threshold; rows without a link too.

    All rows are taken as queries, in blocks; only counts leave the tasks, never pairs.
    """

    def work(who, unit, ids, rows):
        near = np.round(np.clip(unit @ rows.T, -1, 1), 6) > threshold
        own = (who[:, None] == ids[None, :]) & near
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array((near.sum(axis=1) - own.sum(axis=1)).astype(np.int64))], names=["id", "links"])

    return _over_blocks(vectors, vectors, id_column, vector, work, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def similar_to(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, similarity of the k rows most similar to one vector, in column expressions; k = 0 means all rows."""
    out = vectors.select(F.col(id_column).alias("id"), F.round(cosine(F.col(vector), literal(query)), 6).alias("similarity")).filter("similarity is not null")
    return out.orderBy(F.desc("similarity"), "id").limit(k) if k else out


def reranked(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """ranked (id, similarity) with the scores of a reranker where it gave one, placed anew; ties keep the order."""
    joined = ranked.join(scores.select("id", F.col("score").alias("__s")), "id", "left").withColumn("score", F.coalesce("__s", "similarity")).drop("__s")
    return joined.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), F.desc("similarity"), "id")))


def best_matches(base: DataFrame, queries: DataFrame, least: float, limit: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best match of each query of at least `least`, the `limit` best of them."""
    return nearest(base, queries, 1, id_column, vector, least).drop("place").orderBy(F.desc("similarity"), "query_id").limit(limit)
