"""A persisted inverted index for ranked search: written once, then a query reads only its terms' postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import text as t
from loomgrain.operators.search import B, K1

#: Folders over which the terms are spread; a query opens those of its terms.
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(documents: DataFrame, fields: dict[str, Column], folder: str, buckets: int = BUCKETS) -> str:
    """Writes postings (bucket, field, term, doc_id, tf, dl) and totals (field, n, mean) of the fields below a shared folder.

    Words are those of code_words(). A document whose field is null isn't counted; one without words counts with length 0. Postings are
    sorted by term within a bucket, so that statistics of row groups skip most of it; a frequent term's postings are
    spread over tasks by document.
    """
    each = [documents.filter(c.isNotNull()).select("doc_id", F.lit(name).alias("field"), t.code_words(c).alias("w")) for name, c in fields.items()]
    words = each[0]
    for e in each[1:]:
        words = words.unionByName(e)
    words = words.select("doc_id", "field", "w", F.size("w").alias("dl"))
    tf = words.select("doc_id", "field", "dl", F.explode("w").alias("term")).groupBy("doc_id", "field", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    postings = tf.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term")
    postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    words.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).write.mode("overwrite").parquet(f"{folder}/totals")
    return folder


def search_index(spark: SparkSession, folder: str, terms: Sequence[str], limit: int, buckets: int = BUCKETS, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score: the `limit` best documents by the sum of BM25 over the fields, as ranked_search() gives them.

    Only the folders of the terms' buckets are listed and only their terms' rows are read. No terms, or an empty index, give no rows.
    """
    terms = list(dict.fromkeys(terms))
    wanted = sorted({r[0] for r in spark.createDataFrame([(w,) for w in terms], "w string").select(_bucket(F.col("w"), buckets)).collect()})
    hits = spark.read.schema("doc_id bigint, field string, dl int, term string, tf int, bucket int").parquet(f"{folder}/postings").filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    totals = spark.read.schema("field string, n bigint, mean double").parquet(f"{folder}/totals")
    # as many rows as terms and fields
    numbers = df.join(totals, "field").select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    tf = F.col("tf")
    score = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    ranked = hits.join(F.broadcast(numbers), ["field", "term"]).groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"))
    return ranked.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)
