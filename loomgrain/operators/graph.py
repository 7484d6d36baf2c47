"""Graphs of nodes and edges: traversal, reachability, ranks, communities, chains, deltas.

Traversals go level by level: the frontier, without repeated rows, is joined with the edges, and each level is
cut off from its lineage by a checkpoint. What a level adds is found by an anti-join with what is known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.cluster import cut, free

#: Links that one task follows in memory, about 300 bytes each, and links among which one joins neighbours.
WALK_ROWS = 1_000_000
RUN_ROWS = 200_000
#: Bytes of a key: two of 10^10 hashes have the same one with a probability below 10^-9, which is an error then.
KEY = 12


def _step(frontier: DataFrame, edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """target, relation (and kept columns) of the edges that leave the frontier's nodes."""
    out = frontier.select(F.col("node").alias("source"), *keep).join(edges, "source")
    return out.select(F.col("target").alias("node"), "relation", *keep)


def khop(edges: DataFrame, seeds: DataFrame, hops: int, relations: Sequence[str] | None = None) -> DataFrame:
    """node, relation, hops: what is reached over exactly 1, 2 ... hops edges.

    A relation filter holds for the last edge only, and a node may come out at several numbers of hops,
    also the seeds again over a cycle. Seeds that aren't nodes reach nothing.
    """
    edges = cut(edges.select("source", "target", "relation").distinct())
    frontier, out = seeds.select("node").distinct(), None
    for k in range(1, hops + 1):
        level = cut(_step(frontier, edges).distinct())
        part = level.withColumn("hops", F.lit(k))
        out = part if out is None else out.unionByName(part)
        frontier = level.select("node").distinct()
    return out if relations is None else out.filter(F.col("relation").isin(list(relations)))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and least depth (seeds at 0) of all that is reached; cycles end since known nodes aren't visited again."""
    edges = cut(edges.select("source", "target", F.lit("").alias("relation")).distinct())
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    known, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = _step(frontier, edges).select("node").distinct().join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def unreachable(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes that no seed reaches."""
    return nodes.select("node").distinct().join(reachable(edges, seeds).select("node"), "node", "left_anti")


def reach_counts(edges: DataFrame, entries: DataFrame, max_depth: int = 20) -> DataFrame:
    """node, entrypoints: by how many entries each node is reached within max_depth edges, itself excluded at depth 0.

    All entries are followed at once, keyed by entry and node.
    """
    edges = cut(edges.select("source", "target", F.lit("").alias("relation")).distinct())
    frontier = cut(entries.select(F.col("node").alias("entry"), "node").distinct())
    known = frontier
    for _ in range(max_depth):
        frontier = cut(_step(frontier, edges, ["entry"]).select("entry", "node").distinct().join(known, ["entry", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.filter("entry <> node").groupBy("node").agg(F.count("*").alias("entrypoints"))


def one_hop_used(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that some edge from another node points to: reachability within one hop only."""
    return symbols.select("node").distinct().join(edges.filter("source <> target").select(F.col("target").alias("node")), "node", "left_semi")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-11, most: int = 2000) -> DataFrame:
    """node, rank; the ranks sum to 1 and what dead ends hold is spread over all nodes.

    The rounds go on until all ranks together move by no more than tolerance, which leaves an error of at most
    damping / (1 - damping) times that; RuntimeError if `most` rounds don't suffice. With `rounds` exactly so
    many are made, at rest or not.
    """
    links = cut(edges.select("source", "target").distinct())
    out_degree = links.groupBy("source").agg(F.count("*").alias("degree"))
    everyone = cut(nodes.select("node").distinct().join(out_degree.withColumnRenamed("source", "node"), "node", "left"))
    n = everyone.count()
    ranks = everyone.withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("moved", F.lit(0.0))
    for _ in range(most if rounds is None else rounds):
        share = ranks.filter("degree is not null").select(F.col("node").alias("source"), (F.col("rank") / F.col("degree")).alias("share"))
        given = links.join(share, "source").groupBy(F.col("target").alias("node")).agg(F.sum("share").alias("given"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        fresh = ranks.join(given, "node", "left").crossJoin(F.broadcast(lost))
        rank = (1 - damping) / max(n, 1) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / max(n, 1))
        ranks = cut(fresh.select("node", "degree", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")))
        if rounds is None and (ranks.agg(F.sum("moved")).first()[0] or 0.0) <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks still move by more than {tolerance} after {most} rounds")
    return ranks.select("node", "rank")


def _votes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who hears whom (source, target), each node itself too, and the first labels (node, community)."""
    links = edges.select("source", "target").filter("source <> target")
    both = cut(links.unionAll(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    labels = cut(both.select(F.col("source").alias("node")).distinct().withColumn("community", F.col("node")))
    return cut(both.unionAll(labels.select(F.col("node").alias("source"), F.col("node").alias("target")))), labels


def _vote(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after one more round."""
    seen = votes.join(labels.select(F.col("node").alias("target"), "community"), "target").groupBy("source", "community").agg(F.count("*").alias("n"))
    return seen.groupBy(F.col("source").alias("node")).agg(F.max(F.struct("n", (-F.col("community")).alias("label"))).alias("x")).select("node", (-F.col("x.label")).alias("community"))


def communities(edges: DataFrame, most: int = 1000) -> DataFrame:
    """node, community, settled by label propagation over undirected edges, run until nothing moves.

    In each round a node takes the label most frequent among its neighbours and itself, the least of equally
    frequent ones; all nodes move at once. Labels are counted before they are ranked, so a hub's
    neighbours never meet in one list. As all move at once, some nodes of a few graphs swap between two labels
    for ever, while the rest is still: such a node has settled false and the lesser of both labels.
    RuntimeError if neither state is reached within `most` rounds.
    """
    votes, labels = _votes(edges)
    labels = labels.withColumn("before", F.lit(None).cast(labels.schema["community"].dataType))
    for _ in range(most):
        known = labels.select("node", F.col("community").alias("last"), F.col("before").alias("last_but_one"))
        fresh = cut(_vote(votes, labels).join(known, "node").select("node", "community", F.col("last").alias("before"), (F.col("community") != F.col("last")).alias("moved"), (~F.col("community").eqNullSafe(F.col("last_but_one"))).alias("new")))
        moved, new = fresh.agg(F.count_if("moved"), F.count_if("new")).first()
        labels = fresh.select("node", "community", "before")
        if moved == 0 or new == 0:
            return labels.select("node", F.least("community", "before").alias("community"), (F.col("community") == F.col("before")).alias("settled"))
    raise RuntimeError(f"labels still move after {most} rounds")


def label_rounds(edges: DataFrame, rounds: int) -> DataFrame:
    """node, community: the labels of communities() after at most so many rounds, at rest or not."""
    votes, labels = _votes(edges)
    for _ in range(rounds):
        fresh = cut(_vote(votes, labels))
        same = fresh.join(labels.withColumnRenamed("community", "before"), "node").filter("community <> before").isEmpty()
        labels = fresh
        if same:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a division into communities; one row, null without edges."""
    links = edges.select("source", "target").filter("source <> target")
    both = links.unionAll(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    a, b = labels.select(F.col("node").alias("source"), F.col("community").alias("ca")), labels.select(F.col("node").alias("target"), F.col("community").alias("cb"))
    per = both.join(a, "source").join(b, "target").groupBy("ca").agg(F.count("*").alias("degree"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    total = per.agg(F.sum("degree").alias("m"))
    return per.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / F.col("m"), F.lit(2.0))), 6).alias("modularity"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, distinct."""
    e = edges.select("source", "target", "relation")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, nodes: DataFrame | None = None, skipped: Column | None = None) -> DataFrame:
    """node, depth of the nearest nodes around the seeds over edges of either way; nearest first, then by id, at most limit.

    nodes and skipped name nodes through which the search doesn't go.
    """
    both = undirected(edges)
    if nodes is not None and skipped is not None:
        both = both.join(nodes.filter(~skipped).select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("source", "target", "relation")
    return reachable(both, seeds, depth).orderBy("depth", "node").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.select(F.col("node").alias("source")), "source", "left_semi").join(ids.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target", "relation")


def spread_risk(nodes: DataFrame, edges: DataFrame, factor: float = 0.5) -> DataFrame:
    """Each node's risk, raised to factor times the greatest risk of a node that points to it."""
    given = edges.select("source", "target").distinct().join(nodes.select(F.col("node").alias("source"), "risk"), "source").groupBy(F.col("target").alias("node")).agg((F.max("risk") * factor).alias("given"))
    return nodes.select("node", "risk").join(given, "node", "left").select("node", F.greatest("risk", F.coalesce("given", "risk")).alias("risk"))


def call_chains(edges: DataFrame, entries: DataFrame, max_depth: int, skipped: Column | None = None) -> DataFrame:
    """path, length, is_cycle: every simple path from the entries to its end within max_depth edges.

    A path ends at a node without further edges, at max_depth, or where it would return to one of its own
    nodes; then is_cycle is true and that node is repeated as the last one. The number of paths is by its
    nature not bounded by the size of the graph: max_depth and the entries bound it.
    """
    links = edges.select("source", "target").distinct()
    if skipped is not None:
        links = links.filter(~skipped)
    links = cut(links)
    paths = cut(entries.select(F.array("node").alias("path"), F.col("node").alias("last")))
    out = None
    for depth in range(1, max_depth + 1):
        grown = paths.join(links, F.col("last") == F.col("source"), "left")
        is_end = F.col("target").isNull()
        cycle = F.coalesce(F.array_contains("path", F.col("target")), F.lit(False))
        level = cut(grown.select(F.when(is_end, F.col("path")).otherwise(F.array_append("path", F.col("target"))).alias("path"), F.col("target").alias("last"), is_end.alias("ended"), cycle.alias("is_cycle")))
        done = level.filter(F.col("ended") | F.col("is_cycle") | F.lit(depth == max_depth)).select("path", "is_cycle")
        out = done if out is None else out.unionByName(done)
        paths = level.filter("not ended and not is_cycle").select("path", "last")
        if paths.isEmpty():
            break
    return out.select("path", (F.size("path") - 1).alias("length"), "is_cycle")


def chain_coupling(chains: DataFrame, changed: DataFrame, models: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Chains with a data model of which at least a share `threshold` changed: first, last, length, changed, level.

    High for more than 5 nodes or 3 changed ones, else medium.
    """
    rows = chains.withColumn("chain", F.xxhash64("path")).select("chain", "path", F.explode(F.array_distinct("path")).alias("node"))
    marked = rows.join(changed.select("node", F.lit(1).alias("c")).distinct(), "node", "left").join(models.select("node", F.lit(1).alias("m")).distinct(), "node", "left")
    per = marked.groupBy("path").agg(F.count("c").alias("changed"), F.max("m").alias("has_model"), F.count("*").alias("nodes"))
    level = F.when((F.col("nodes") > 5) | (F.col("changed") >= 3), "high").otherwise("medium")
    return per.filter((F.col("has_model") == 1) & (F.col("changed") / F.col("nodes") >= threshold)).select(F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"), "nodes", "changed", level.alias("level"))


def graph_delta(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """kind, id: nodes added, removed and updated, edges added and removed between two graphs.

    nodes: node and any further columns, which are compared null-safe as a whole. One full join for nodes and
    one for edges.
    """
    rest = [c for c in old_nodes.columns if c != "node"]
    a = old_nodes.select("node", F.struct(*rest).alias("a"), F.lit(1).alias("in_a"))
    b = new_nodes.select("node", F.struct(*rest).alias("b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "node_added").when(F.col("in_b").isNull(), "node_removed").when(~F.col("a").eqNullSafe(F.col("b")), "node_updated")
    nodes = a.join(b, "node", "full").select(state.alias("kind"), F.col("node").cast("string").alias("id")).filter("kind is not null")
    columns = ["source", "target", "relation"]
    x, y = old_edges.select(*columns).distinct().withColumn("in_a", F.lit(1)), new_edges.select(*columns).distinct().withColumn("in_b", F.lit(1))
    edge_state = F.when(F.col("in_a").isNull(), "edge_added").when(F.col("in_b").isNull(), "edge_removed")
    edges = x.join(y, columns, "full").select(edge_state.alias("kind"), F.concat_ws(">", *columns).alias("id")).filter("kind is not null")
    return nodes.unionByName(edges)


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """paths with the deepest root that is an ancestor of each; null without one.

    A path's ancestors are listed, which are as many as it has folders, and joined by equality.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    long = paths.select(F.col(path).alias("__p"), F.posexplode(ancestors).alias("depth", "__root")).distinct()
    best = long.join(roots.select(F.col(root).alias("__root")).distinct(), "__root").groupBy("__p").agg(F.max_by("__root", "depth").alias("service"))
    return paths.join(best, F.col(path) == F.col("__p"), "left").drop("__p")


def cross_service(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Calls between different services: from_service, to_service, n. owner: node, service."""
    a, b = owner.select(F.col("node").alias("source"), F.col("service").alias("from_service")), owner.select(F.col("node").alias("target"), F.col("service").alias("to_service"))
    return edges.select("source", "target").join(a, "source").join(b, "target").filter("from_service <> to_service").groupBy("from_service", "to_service").agg(F.count("*").alias("n"))


def build_graph(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of typed parts: distinct nodes, the first category by name winning, and distinct edges."""
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n, allowMissingColumns=True), edges.unionByName(e, allowMissingColumns=True)
    return nodes.groupBy("node").agg(F.min("category").alias("category"), F.min_by("label", "category").alias("label")), edges.select("source", "target", "relation").distinct()


def _key(text: Column) -> Column:
    """KEY bytes that stand for a hash of any form: the first of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * KEY))


def _coded(rows: pa.Table) -> tuple[pa.Array, list[int]]:
    """All keys of the rows, first `id` in the order of rows, and the place of each row's `next` among them."""
    keys = pa.concat_arrays([*rows["id"].chunks, *rows["next"].chunks]).dictionary_encode()
    return keys.dictionary, keys.indices.to_numpy()[rows.num_rows :].tolist()


def _runs(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[pa.RecordBatch]:
    """Links id → next joined where both lie among the same rows_at_once or so: id, next, steps, and the keys `inside` in a row."""

    def joined(rows: pa.Table) -> pa.RecordBatch:
        keys, follow = _coded(rows)
        keys, n = keys.to_pylist(), rows.num_rows
        led = bytearray(len(keys))
        for x in follow:
            led[x] = 1
        done, out = bytearray(n), ([], [], [], [])
        for at in [*(i for i in range(n) if not led[i]), *range(n)]:  # a ring has no first link: it begins anywhere
            if done[at]:
                continue
            done[at], inside, x = 1, [], follow[at]
            while x < n and not done[x]:
                done[x] = 1
                inside.append(keys[x])
                x = follow[x]
            for column, value in zip(out, (keys[at], keys[x], len(inside) + 1, b"".join(inside)), strict=True):
                column.append(value)
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["id", "next", "steps", "inside"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows_at_once:
            yield joined(pa.Table.from_batches(held))
            held = []
    if any(x.num_rows for x in held):
        yield joined(pa.Table.from_batches(held))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, place of what is met from the empty key on, up to an end or to what was met before."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    keys, follow = _coded(rows)
    steps, place, far = rows["steps"].to_pylist(), [-1] * len(keys), 0
    at, met = keys.index(pa.scalar(b"", keys.type)).as_py(), []
    while at >= 0 and place[at] < 0:
        place[at] = far
        met.append(at)
        if at >= rows.num_rows:
            break
        far, at = far + steps[at], follow[at]
    yield from pa.table({"id": keys.take(pa.array(met, pa.int64())).cast(pa.binary()), "place": pa.array([place[x] for x in met], pa.int64())}).to_batches(100_000)


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, place of the keys inside runs whose first key has a place."""
    for batch in batches:
        for place, inside in zip(batch["place"].to_pylist(), batch["inside"].to_pylist(), strict=True):
            for i in range(0, len(inside), KEY * 100_000):
                part = inside[i : i + KEY * 100_000]
                n, first = len(part) // KEY, place + 1 + i // KEY
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), n, [None, pa.py_buffer(part)]).cast(pa.binary())
                yield pa.record_batch([ids, pa.array(range(first, first + n), pa.int64())], ["id", "place"])


def _places(links: DataFrame, at_once: int) -> DataFrame:
    """id, place: the steps from the empty key to each key of the links id → next (steps) that is met on the way.

    While there are more than at_once links, keys of which no two follow each other are taken out, about a
    quarter in a round, and what led to them leads on; the rest is walked by one task, and what was taken out
    is put back behind the key that led to it.
    """
    out = []
    while links.count() > at_once:
        heads = [F.xxhash64(F.lit(len(out)), F.col(c)).bitwiseAND(1) == 1 for c in ("id", "next")]
        goes = heads[0] & ~heads[1] & (F.length("id") > 0)
        gone = links.filter(goes).select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("steps").alias("__steps"))
        round_ = cut(
            links.filter(~goes).join(gone, "next", "left").select("id", F.coalesce("__next", "next").alias("next"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.when(F.col("__next").isNotNull(), F.col("next")).alias("gone"), F.when(F.col("__next").isNotNull(), F.col("steps")).alias("after"))
        )
        out.append(round_.filter("gone is not null").select("id", "gone", "after"))
        links = round_.filter("id <> next").select("id", "next", "steps")
    known = links.repartition(1).mapInArrow(_walk, "id binary, place bigint")
    for gone in reversed(out):
        both = F.explode(F.array(F.struct("id", "place"), F.struct(F.col("gone").alias("id"), (F.col("place") + F.col("after")).alias("place"))))
        known = known.join(gone, "id", "left").select(both.alias("x")).select("x.*").filter("id is not null").groupBy("id").agg(F.min("place").alias("place"))
    return known


def walk_chain(entries: DataFrame, order: str, at_once: int = WALK_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """hash, place of the entries that hang together from the genesis on; other entries have a null place.

    The genesis is the entry without predecessor of the least `order`; at a fork the child of the least hash
    goes on. Each entry's links are moved once to find the heirs, once to lie by `order`, where neighbours of the
    chain mostly meet and are joined to runs, and runs alone are followed (_places). Hashes are carried as short
    keys, or as their bytes where they are hex digits, the key last, where its padding compresses away. In whatever
    order the links lie, the result is the same.
    """
    own = entries.select("hash", "prev", F.col(order).alias("__o"))
    is_hex = F.col("hash").rlike(r"^([0-9a-f]{2})+\z")
    packed, plain = F.when(is_hex, F.unhex("hash")), F.when(~is_hex, F.col("hash"))
    genesis = own.filter("prev is null").orderBy("__o", "hash").limit(1).filter("hash is not null").select(F.expr("X''").alias("id"), _key(F.col("hash")).alias("next"), F.lit(0).cast("bigint").alias("steps"))
    children = own.filter("prev is not null and prev <> hash").select(packed.alias("b"), plain.alias("t"), "__o", _key(F.col("prev")).alias("id")).repartition("id")
    least = children.groupBy("id").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("b", "__o"))).alias("b"), F.min(F.when(F.col("t").isNotNull(), F.struct("t", "__o"))).alias("t"))
    text = F.lower(F.hex("b.b"))
    is_text = F.col("b").isNull() | F.coalesce(F.col("t.t") < text, F.lit(False))
    both = F.concat("id", _key(F.when(is_text, F.col("t.t")).otherwise(text)))
    ordered = least.select(F.when(is_text, F.col("t.__o")).otherwise(F.col("b.__o")).alias("__o"), both.alias("both")).repartitionByRange("__o").sortWithinPartitions("__o")
    links = ordered.select(F.substring("both", 1, KEY).alias("id"), F.substring("both", KEY + 1, KEY).alias("next"))
    runs = cut(links.mapInArrow(lambda batches: _runs(batches, run_rows), "id binary, next binary, steps bigint, inside binary"))
    places = cut(_places(runs.select("id", "next", "steps").unionByName(genesis), at_once))
    last = places.orderBy(F.desc("place")).first()
    if last is None or runs.filter(F.contains("inside", F.lit(last["id"]))).isEmpty():
        within = runs.filter("steps > 1").join(places, "id").select("place", "inside").mapInArrow(_unfolded, "id binary, place bigint")
        places = places.unionByName(within)
    else:  # a hash with two predecessors is met inside a run: links are followed one by one
        places = _places(cut(links.withColumn("steps", F.lit(1).cast("bigint"))).unionByName(genesis), at_once)
    free(entries.sparkSession)
    hashes = own.select(packed.alias("b"), plain.alias("t"), _key(F.col("hash")).alias("id")).repartition("id").groupBy("id").agg(*(f(c).alias(f"{k}_{c}") for c in "bt" for k, f in (("min", F.min), ("max", F.max))))
    one = F.when(F.expr("min_b <> max_b or min_t <> max_t or (min_b is not null and min_t is not null)"), F.raise_error(F.lit("two hashes have the same key")).cast("string")).otherwise(F.coalesce("min_t", F.lower(F.hex("min_b"))))
    return hashes.join(places.groupBy("id").agg(F.min("place").alias("place")), "id", "left").select(one.alias("hash"), "place")


def chain_faults(entries: DataFrame) -> DataFrame:
    """kind, hash: forks (a predecessor with several children), orphans (an unknown one) and extra geneses."""
    own = entries.select("hash", "prev", "ord")
    forks = own.filter("prev is not null").groupBy("prev").agg(F.count_distinct("hash").alias("n")).filter("n > 1").select(F.lit("fork").alias("kind"), F.col("prev").alias("hash"))
    orphans = own.filter("prev is not null").join(own.select(F.col("hash").alias("prev")).distinct(), "prev", "left_anti").select(F.lit("orphan").alias("kind"), "hash")
    first = own.filter("prev is null").select("hash", F.struct("ord", "hash").alias("o"))
    least = first.agg(F.min("o").alias("least"))
    extra = first.crossJoin(F.broadcast(least)).filter("o <> least").select(F.lit("extra_genesis").alias("kind"), "hash")
    return forks.unionByName(orphans).unionByName(extra)


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, callee, state: RESOLVED with one symbol of the name, AMBIGUOUS with more, UNRESOLVED with none."""
    by_name = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("callee"))
    joined = calls.join(by_name, "name", "left")
    state = F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return joined.select("call_id", F.when(F.col("n") == 1, F.col("callee")).alias("callee"), state.alias("state"))


def capped_edges(edges: DataFrame, group: str, first: Column, tie: str, cap: int) -> DataFrame:
    """edges with state CAPPED beyond the first `cap` of each group in the given order, else KEPT."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(first.desc(), F.asc(tie)))
    return edges.withColumn("state", F.when(rank > cap, "CAPPED").otherwise("KEPT"))
