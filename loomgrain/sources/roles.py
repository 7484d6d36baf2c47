"""Role views: the tables at hand in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.sources.tables import table

#: The same views for the SQL side; each query takes what it needs.
SQL = {
    "change_log": "select o_orderkey as commit_id, o_orderdate as ts, l_suppkey as file, o_orderpriority = '1-URGENT' as is_merge from orders join lineitem on l_orderkey = o_orderkey",
    "commits": "select o_orderkey as commit_id, o_orderdate as ts, o_orderpriority = '1-URGENT' as is_merge, o_custkey as author from orders",
    "symbols": "select p_partkey as symbol_id, p_partkey % 100 as file, p_name as name, p_type as kind, p_brand as language, p_size as cognitive, p_size * 2 % 37 as cyclomatic, p_size % 2 = 1 as is_public from part",
    "calls": "select distinct l_partkey as source, l_orderkey % 2000 as target, case when l_linenumber % 3 = 0 then 'calls' when l_linenumber % 3 = 1 then 'imports' else 'tests' end as relation from lineitem where l_partkey <> l_orderkey % 2000",
    "timings": "select event_id, ts, event_type as command, cast(round(value * 100) as bigint) as duration_ms, case when event_id % 3 = 0 then 'k' || cast(event_id % 10 as varchar) end as span_name, user_id % 5 as repo from events",
    "outcomes": "select l_orderkey as diff_id, l_suppkey as test_file, l_returnflag = 'R' as failed, o_orderdate as recorded_at from lineitem join orders on o_orderkey = l_orderkey",
    "runs": "select o_orderkey as run_id, o_orderdate as ts, o_orderstatus = 'F' as overall_pass, o_custkey as tx from orders",
    "steps": "select l_orderkey as run_id, l_suppkey as command, l_linenumber as step, l_returnflag = 'R' as failed, cast(l_quantity as bigint) as duration_ms from lineitem",
}


def with_sql(names: str, query: str) -> str:
    """query with the named role views before it."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names.split()) + (", " if query.lstrip().startswith("+") else " ") + query.lstrip().lstrip("+")


def change_log(spark: SparkSession, where: str) -> DataFrame:
    """commit_id, ts, file, is_merge: a row for each file of each commit."""
    orders, lines = table(spark, where, "orders"), table(spark, where, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("l_suppkey").alias("file"), (F.col("o_orderpriority") == "1-URGENT").alias("is_merge"))


def commit_files(spark: SparkSession, where: str) -> DataFrame:
    """commit_id, file: the change log without what commits() knows, for operators that join the commits they need."""
    return table(spark, where, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"))


def commits(spark: SparkSession, where: str) -> DataFrame:
    """commit_id, ts, is_merge, author: a row for each commit, those without files included."""
    return table(spark, where, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_merge"), F.col("o_custkey").alias("author"))


def symbols(spark: SparkSession, where: str) -> DataFrame:
    """symbol_id, file, name, kind, language, cognitive, cyclomatic, is_public."""
    size = F.col("p_size")
    return table(spark, where, "part").select(
        F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 100).alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("language"), size.alias("cognitive"), (size * 2 % 37).alias("cyclomatic"), (size % 2 == 1).alias("is_public")
    )


def calls(spark: SparkSession, where: str) -> DataFrame:
    """source, target, relation: the edges of a symbol graph."""
    n = F.col("l_linenumber") % 3
    relation = F.when(n == 0, "calls").when(n == 1, "imports").otherwise("tests")
    edges = table(spark, where, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_orderkey") % 2000).alias("target"), relation.alias("relation"))
    return edges.filter("source <> target").distinct()


def timings(spark: SparkSession, where: str) -> DataFrame:
    """event_id, ts, command, duration_ms, span_name (null for whole commands), repo."""
    span = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string")))
    return table(spark, where, "events").select("event_id", "ts", F.col("event_type").alias("command"), F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"), span.alias("span_name"), (F.col("user_id") % 5).alias("repo"))


def outcomes(spark: SparkSession, where: str) -> DataFrame:
    """diff_id, test_file, failed, recorded_at."""
    orders, lines = table(spark, where, "orders"), table(spark, where, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("diff_id"), F.col("l_suppkey").alias("test_file"), (F.col("l_returnflag") == "R").alias("failed"), F.col("o_orderdate").alias("recorded_at"))


def runs(spark: SparkSession, where: str) -> DataFrame:
    """run_id, ts, overall_pass, tx: verification runs."""
    return table(spark, where, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("overall_pass"), F.col("o_custkey").alias("tx"))


def steps(spark: SparkSession, where: str) -> DataFrame:
    """run_id, command, step, failed, duration_ms: results of verification runs."""
    return table(spark, where, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("command"), F.col("l_linenumber").alias("step"), (F.col("l_returnflag") == "R").alias("failed"), F.col("l_quantity").cast("bigint").alias("duration_ms"))


def newest_first(df: DataFrame, by: str, tie: str, name: str, limit: int | None = None) -> DataFrame:
    """The newest rows of df with their ordinal from 0.

    With a limit the rows are cut to a top-k first, which needs no global sort, so that the ordinal is
    made over `limit` rows only. Without one all rows are ranked in one task; give a limit for large tables.
    """
    if limit is not None:
        df = df.orderBy(F.desc(by), F.asc(tie)).limit(limit)
    return df.withColumn(name, F.row_number().over(W.orderBy(F.desc(by), F.asc(tie))) - 1)
