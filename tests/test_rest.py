"""Discovery, siblings, rules, registry, merges: what no SQL covers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrain.functions import text as t
from loomgrain.functions import vectors as fv
from loomgrain.operators import facts, ledger, risk, timings, vectors
from loomgrain.plans import registry
from loomgrain.sources import files

AT = datetime(2024, 1, 1)


def test_discovery(spark, tmp_path):
    for name, content in {"a.rs": b"fn a", "b.md": b"x", "sub/c.rs": b"\xff ok", "sub/d.rs": b"a\0b", "skip/e.rs": b"e", "big.rs": b"x" * 200}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    out = {r.path: r.text for r in files.discover(spark, str(tmp_path), ["rs"], ["skip/**"], 100).collect()}
    assert out == {"a.rs": "fn a", "sub/c.rs": "� ok"}


def test_siblings(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(1).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b"))
    df, warnings = files.read_siblings(spark, {"a": str(tmp_path / "a"), "none": str(tmp_path / "none"), "b": str(tmp_path / "b")})
    assert sorted((r.repo, r.id, r.x) for r in df.collect())[0] == ("a", 0, None) and len(warnings) == 1
    assert files.read_siblings(spark, {})[0] is None


@pytest.mark.parametrize("glob,path,fits", [("*.rs", "a/b.rs", True), ("*.rs", "a/b.rst", False), ("src/*", "src/a", True), ("src/*", "src/a/b", False), ("src/**", "src/a/b", True), ("**/x", "x", True), ("a?c", "abc", True), ("a.c", "abc", False), ("x/(y)", "x/(y)", True)])
def test_globs(spark, glob, path, fits):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.filter(facts.matches_any(F.col("p"), [glob])).count() == int(fits)
    assert df.filter(facts.matches_any(F.col("p"), [])).count() == 0


def test_registry_of_providers(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    good = lambda c: c["t"].select("key", F.lit("r").alias("reason"), (F.col("n") * 30).alias("weight"))
    rows, warnings = risk.Registry().add("good", good).add("bad", lambda c: c["missing"]).add("again", good).run({"t": df})
    assert len(warnings) == 1 and {(r.key, r.level) for r in risk.levels(rows).collect()} == {("a", "high"), ("b", "high")}
    assert {(r.key, r.level) for r in risk.levels(rows.filter("provider = 'good' and key = 'a'")).collect()} == {("a", "medium")}
    with pytest.raises(ValueError):
        risk.Registry().add("x", good).add("x", good)


def test_clock_order_and_last_writer(spark):
    stone = spark.createDataFrame([("a", "5-0-n"), ("b", "5-1-n-x"), ("c", "bad"), ("d", None)], "k string, h string")
    rows = spark.createDataFrame([("a", "5-0-n", 1), ("a", "4-9-z", 2), ("b", "5-2-a", 3), ("c", "1-0-x", 4), ("d", "x", 5), ("e", "10-0-a", 6), ("e", "9-9-z", 7)], "k string, c string, v int")
    out = ledger.last_writer(rows, "k", ledger.clock(F.col("c")), stone, ledger.clock(F.col("h")))
    assert sorted((r.k, r.v) for r in out.collect()) == [("b", 3), ("c", 4), ("e", 6)]


def test_latest_takes_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 1), ("a", 2, 3), (None, 1, 1), ("n", None, None)], "k string, t int, v int")
    assert sorted(map(tuple, ledger.latest(df, ["k"], ["t"]).collect()), key=str) == sorted([("a", 2, 3), (None, 1, 1), ("n", None, None)], key=str)
    assert ledger.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_upsert_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    new = spark.createDataFrame([(2, "b"), (1, "x"), (4, None), (3, None)], "k int, h string")
    assert sorted(map(tuple, ledger.upsert(old, new, "k", "h").collect())) == [(1, "x", "updated"), (2, "b", "unchanged"), (3, None, "unchanged"), (4, None, "inserted")]
    rest = ledger.cascade({"d": (old.withColumnRenamed("k", "ref"), "ref")}, new.filter("k = 1"), "k")
    assert sorted(r.ref for r in rest["d"].collect()) == [2, 3]


def test_cosine_of_bad_vectors(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0]), ([float("inf"), 1.0], [1.0, 1.0]), (None, [1.0]), ([1.0, 0.0], [-3.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(fv.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None, None, None, -1.0]


def test_nearest_of_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0]), (7, [None, 1.0])], "vec_id bigint, embedding array<double>")
    out = sorted(map(tuple, vectors.nearest(df, df.filter("vec_id in (1, 3)"), 2).collect()))
    assert out == [(1, 2, 1.0, 1), (1, 6, 0.0, 2)]
    assert vectors.nearest(df.limit(0), df, 2).count() == 0 and vectors.nearest(df, df.limit(0), 2).count() == 0
    assert {(r.id, r.links) for r in vectors.link_counts(df, 0.9).collect()} == {(1, 1), (2, 1), (6, 0)}


def test_failure_probability_guards(spark):
    schema = "diff_id int, test_file string, failed boolean, recorded_at timestamp"
    make = lambda n, failed: spark.createDataFrame([(i, "t", failed, AT + timedelta(hours=i)) for i in range(n)], schema)
    assert timings.failure_probability(make(9, True)).count() == 0
    assert timings.failure_probability(make(10, False)).count() == 0
    assert [tuple(r) for r in timings.failure_probability(make(10, True)).collect()] == [("t", 10, 10, round(11 / 12, 6))]
    assert timings.failure_probability(make(10, True), newest_diffs=4).count() == 0


def test_nearest_rank_equals_formula(spark):
    values = [5, 1, 9, 9, 3, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7)], "k string, v int")
    kept = sorted(v for v in values if v is not None)
    out = {r.k: r for r in timings.percentile_ranks(df, ["k"], "v", (0, 50, 95, 100)).collect()}
    pick = lambda p: kept[int(p / 100 * (len(kept) - 1) + 0.5)]
    assert (out["a"].p0, out["a"].p50, out["a"].p95, out["a"].p100) == tuple(map(pick, (0, 50, 95, 100)))
    assert out["b"].p50 == 7
    listed = df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("l")).select("k", timings.nearest_rank(F.col("l"), 95).alias("p"))
    assert {r.k: r.p for r in listed.collect()} == {k: r.p95 for k, r in out.items()}


def test_small_scalars(spark):
    df = spark.createDataFrame([("90d",), ("2w",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(t.age_days(F.col("a"))).collect()] == [90, 14, None, None]
    days = spark.createDataFrame([(1,), (30,), (60,), (61,), (None,)], "d int")
    assert [r[0] for r in days.select(t.staleness_tier(F.col("d"), 30)).collect()] == [None, "warning", "warning", "critical", None]


def test_names_are_unique_and_callable():
    queries = registry.queries()
    assert len(queries) > 150 and all(callable(q) for q in queries.values())


def test_dealt_vector_blocks_equal_broadcast_ones(spark, monkeypatch):
    import random

    from loomgrain.operators import vectors

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(90)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0]), (93, [1.0, 2.0, 3.0]), (94, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    calls = lambda: (sorted(map(tuple, vectors.link_counts(df, 0.9).collect())), sorted(map(tuple, vectors.nearest(df, df, 3).collect())))
    near = calls()
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "STRIPE", 32)
    assert near == calls() and dict(near[0])[93] >= 1
