"""Streams over small folders, run to their end."""

from datetime import datetime

from pyspark.sql import functions as F

from loomgrain.cluster import broadcast_if, use_checkpoint_dir
from loomgrain.operators import graph
from loomgrain.streaming import streams as s

AT = datetime(2024, 1, 1)


def folder(spark, tmp_path, name, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"p{i}"))
    return str(tmp_path / name / "*")


def test_debounced_merge(spark, tmp_path):
    schema = "path string, kind string, ts timestamp"
    where = folder(spark, tmp_path, "in", [[("a", "Modified", AT), ("a", "Unknown", AT), ("b", "Added", AT), ("x.tmp", "Added", AT)]], schema)
    table = str(tmp_path / "table")
    stream = s.read_files(spark, where, schema)
    query = s.debounced(stream, s.merge_batch(spark, table, "path"), str(tmp_path / "marks"), ignored=F.col("path").endswith(".tmp"), every=None)
    query.awaitTermination()
    assert {(r.path, r.kind) for r in spark.read.parquet(f"{table}/version=0").collect()} == {("a", "Modified"), ("b", "Added")}
    s.merge_batch(spark, table, "path")(spark.createDataFrame([("a", "Deleted"), ("c", "Added")], "path string, kind string"), 1)
    assert {r.path for r in spark.read.parquet(f"{table}/version=1").collect()} == {"b", "c"}


def test_delta_of_a_batch(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", 1), ("b", 1)], "node string, v int"), spark.createDataFrame([("a", "b", "r")], "source string, target string, relation string")
    handle = s.delta_batch((nodes, edges), lambda df: (df, edges.limit(0)), str(tmp_path / "out"))
    handle(spark.createDataFrame([("a", 2), ("c", 1)], "node string, v int"), 0)
    out = {(r.kind, r.id) for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()}
    assert out == {("node_updated", "a"), ("node_removed", "b"), ("node_added", "c"), ("edge_removed", "a>b>r")}


def test_stream_windows_equal_batch(spark, tmp_path):
    schema = "event_type string, value double, ts timestamp_ntz"
    rows = [("a", 1.0, datetime(2024, 1, 1, h, 30)) for h in range(5)] + [("b", None, AT), (None, 2.0, AT)]
    where = folder(spark, tmp_path, "w", [rows[:3], rows[3:]], schema)
    out = s.run_to_table(s.windowed(s.read_files(spark, where, schema), "2 hours"), "complete", "t")
    batch = s.windowed(spark.createDataFrame(rows, schema), "2 hours")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out.select(*batch.columns)) == key(batch)


def test_clocks_never_go_back(spark, tmp_path):
    schema = "node string, physical bigint, counter bigint"
    where = folder(spark, tmp_path, "c", [[("n", 5, 0), ("n", 5, 3), ("n", 4, 9), ("m", 1, 1)]], schema)
    out = s.run_to_table(s.observed_clocks(s.read_files(spark, where, schema)), "update", "clocks")
    assert {tuple(r) for r in out.collect()} == {("n", 5, 4), ("m", 1, 2)}


def test_graph_of_nothing(spark):
    edges = spark.createDataFrame([], "source int, target int, relation string")
    nodes = spark.createDataFrame([(1,), (1,), (2,)], "node int")
    assert graph.khop(edges, nodes, 2).count() == 0
    assert {tuple(r) for r in graph.reachable(edges, nodes).collect()} == {(1, 0), (2, 0)}
    assert [round(r.rank, 6) for r in graph.pagerank(edges, nodes, 3).collect()] == [0.5, 0.5]
    assert graph.communities(edges).count() == 0
    cycle = spark.createDataFrame([(1, 2, "r"), (2, 1, "r"), (2, 2, "r")], "source int, target int, relation string")
    assert {tuple(r) for r in graph.reachable(cycle, nodes.filter("node = 1")).collect()} == {(1, 0), (2, 1)}
    chains = {(tuple(r.path), r.is_cycle) for r in graph.call_chains(cycle, nodes.filter("node = 1").distinct(), 4).collect()}
    assert chains == {((1, 2, 1), True), ((1, 2, 2), True)}


def test_cluster_helpers(spark):
    use_checkpoint_dir(spark)
    use_checkpoint_dir(spark)
    df = spark.range(3)
    assert broadcast_if(df, 10, 5) is df and broadcast_if(df, 3, 5) is not df
