"""Command timings and verification runs: percentiles, summaries, trends, probabilities, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(values: Column, percent: float) -> Column:
    """Element round(p (n - 1) / 100) of a sorted array, halves away from zero; null for an empty one."""
    return F.get(values, F.round(F.lit(percent / 100) * (F.size(values) - 1)).cast("int"))


def percentile_ranks(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], width: int = 1024) -> DataFrame:
    """keys and p50, p95 ...: nearest-rank percentiles of each group.

    Equal values of a group are counted before they are ranked, in two levels: over slices of the values, `width` wide,
    and then only within the slices that hold a wanted rank. So a group of any size is spread over its
    slices, and no list of a group's values is made.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("__slice"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*keys)
    slices = counts.groupBy(*keys, "__slice").agg(F.sum("__n").alias("__in"))
    slices = slices.withColumn("__before", F.sum("__in").over(w.orderBy("__slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("__in")).withColumn("__all", F.sum("__in").over(w))
    at = lambda p: F.round(F.lit(p / 100) * (F.col("__all") - 1)).cast("bigint")
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), at(p).alias("rank")) for p in percents)))
    held = slices.select(*keys, "__slice", "__before", "__in", wanted.alias("x")).filter((F.col("x.rank") >= F.col("__before")) & (F.col("x.rank") < F.col("__before") + F.col("__in")))
    held = held.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__slice").alias("__s"), F.col("x.p").alias("__p"), (F.col("x.rank") - F.col("__before")).alias("__rank"))
    same = F.col("__slice") == F.col("__s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = counts.join(held, same).withColumn("__upto", F.sum("__n").over(W.partitionBy(*keys, "__p", "__slice").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    picked = [F.min(F.when((F.col("__p") == p) & (F.col("__upto") > F.col("__rank")), F.col("__v"))).alias(f"p{p}") for p in percents]
    return inside.groupBy(*keys).agg(*picked)


def select_timings(timings: DataFrame, inner: bool | None = None, command: str | None = None, since=None, limit: int | None = None) -> DataFrame:
    """Timing rows by optional filters, newest first (greatest event_id first among equal times)."""
    if inner is not None:
        timings = timings.filter(F.col("span_name").isNotNull() if inner else F.col("span_name").isNull())
    if command is not None:
        timings = timings.filter(F.col("command") == command)
    if since is not None:
        timings = timings.filter(F.col("ts") >= since)
    return timings.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit is not None else timings


def command_summary(timings: DataFrame, limit: int | None = None) -> DataFrame:
    """command, runs, p50, p95, p99, total of whole commands; greatest total first, then the name."""
    outer = timings.filter("span_name is null")
    sums = outer.groupBy("command").agg(F.count("*").alias("runs"), F.sum("duration_ms").alias("total"))
    out = sums.join(percentile_ranks(outer, ["command"], "duration_ms", (50, 95, 99)), "command", "left")
    return out.orderBy(F.desc("total"), "command").limit(limit) if limit is not None else out


def inner_spans(timings: DataFrame, newest: int) -> DataFrame:
    """Count, sum and maximum of each span over the newest rows only; the limit comes before the aggregation."""
    rows = timings.filter("span_name is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
    return rows.groupBy("command", "span_name").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("longest"))


def pooled_summary(timings: DataFrame) -> DataFrame:
    """Runs, total and maximum of each command over all repositories (repo null, level 1) and within each (level 0)."""
    spread = timings.filter("span_name is null").groupingSets([["command"], ["repo", "command"]], "repo", "command")
    return spread.agg(F.grouping("repo").cast("int").alias("pooled"), F.count("*").alias("runs"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("longest"))


def span_cardinality(timings: DataFrame, most: int) -> DataFrame:
    """Distinct span names of each command and whether they are more than `most`."""
    return timings.groupBy("command").agg(F.count_distinct("span_name").alias("spans")).withColumn("over", F.col("spans") > most)


def daily_rollup(snapshots: DataFrame, ts: str = "recorded_at", score: str = "score", high: float = 3.0) -> DataFrame:
    """Per day, over its newest snapshot: clamp(20 avg ln(1 + 1000 score), 0, 100), files and files of a high display score."""
    days = snapshots.withColumn("day", F.to_date(ts))
    newest = days.groupBy("day").agg(F.max(ts).alias("__newest"))
    shown = F.log1p(F.col(score) * 1000)
    rows = days.join(newest.withColumnRenamed("day", "__day"), (F.col("day") == F.col("__day")) & (F.col(ts) == F.col("__newest")))
    return rows.groupBy("day").agg(F.round(F.least(F.greatest(20 * F.avg(shown), F.lit(0.0)), F.lit(100.0)), 6).alias("project_score"), F.count("*").alias("files"), F.count_if(shown >= high).alias("high_risk"))


def week_over_week(timings: DataFrame, as_of, recent_limit: int = 100, window_limit: int = 200, flat: float = 1.0) -> DataFrame:
    """command, recent, previous, delta_percent, trend of each command's mean duration.

    recent: rows of the last 7 days, the newest recent_limit of them; previous: those of the newest
    window_limit rows of the last 14 days that aren't recent. Within one percent the trend is flat.
    """
    as_of = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    rows = timings.filter("span_name is null").filter((F.col("ts") >= as_of - F.expr("interval 14 days")) & (F.col("ts") <= as_of))
    order = [F.desc("ts"), F.desc("event_id")]
    in_week = F.col("ts") >= as_of - F.expr("interval 7 days")
    ranked = rows.withColumn("week", in_week).withColumn("k", F.row_number().over(W.partitionBy("command").orderBy(*order))).filter(F.col("k") <= max(window_limit, recent_limit))
    recent = F.col("week") & (F.col("k") <= recent_limit)
    means = ranked.groupBy("command").agg(F.avg(F.when(recent, F.col("duration_ms"))).alias("recent"), F.avg(F.when(~recent & (F.col("k") <= window_limit), F.col("duration_ms"))).alias("previous"))
    delta = F.when(F.col("previous") != 0, (F.col("recent") - F.col("previous")) / F.col("previous") * 100)
    out = means.withColumn("delta_percent", F.round(delta, 6))
    return out.select("command", F.round("recent", 6).alias("recent"), F.round("previous", 6).alias("previous"), "delta_percent", F.when(F.col("delta_percent").isNull(), "unknown").when(F.abs("delta_percent") <= flat, "flat").when(F.col("delta_percent") > 0, "up").otherwise("down").alias("trend"))


def retained(timings: DataFrame, as_of, outer_days: int, inner_days: int) -> DataFrame:
    """Rows that a retention by age keeps: whole commands for outer_days, spans for inner_days."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return timings.filter(F.col("ts") >= F.when(F.col("span_name").isNull(), as_of - F.make_interval(days=F.lit(outer_days))).otherwise(as_of - F.make_interval(days=F.lit(inner_days))))


def verification_trend(runs: DataFrame) -> DataFrame:
    """Passed and failed runs of each day; a null result counts as neither."""
    return runs.groupBy(F.to_date("ts").alias("day")).agg(F.count_if("overall_pass").alias("passed"), F.count_if(~F.col("overall_pass")).alias("failed"))


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs, the greatest id first among equal times."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def step_stats(steps: DataFrame, runs: DataFrame, recent_runs: int) -> DataFrame:
    """Per command: executions, failures, mean duration, newest run, failures within the newest runs."""
    all_time = steps.join(runs.select("run_id", "ts"), "run_id").groupBy("command").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("ts").alias("last_ts"))
    recent = steps.join(last_runs(runs, recent_runs).select("run_id"), "run_id", "left_semi").groupBy("command").agg(F.count_if("failed").alias("recent_failures"))
    return all_time.join(recent, "command", "left").withColumn("recent_failures", F.coalesce("recent_failures", F.lit(0)))


def failure_probability(outcomes: DataFrame, newest_diffs: int = 1000, least_runs: int = 10) -> DataFrame:
    """test_file, runs, fails, probability (f + 1) / (n + 2) over the newest distinct diffs.

    Empty where there are fewer than least_runs diffs or no failure at all.
    """
    diffs = outcomes.groupBy("diff_id").agg(F.max("recorded_at").alias("at")).orderBy(F.desc("at"), F.desc("diff_id")).limit(newest_diffs)
    rows = outcomes.join(F.broadcast(diffs.select("diff_id")), "diff_id", "left_semi")
    per_test = rows.groupBy("test_file").agg(F.count("*").alias("runs"), F.count_if("failed").alias("fails"))
    guard = rows.agg(F.count_distinct("diff_id").alias("__diffs"), F.count_if("failed").alias("__fails"))
    kept = per_test.crossJoin(F.broadcast(guard)).filter((F.col("__diffs") >= least_runs) & (F.col("__fails") > 0))
    return kept.select("test_file", "runs", "fails", F.round((F.col("fails") + 1) / (F.col("runs") + 2), 6).alias("probability"))


def ordered_steps(steps: DataFrame, probability: DataFrame) -> DataFrame:
    """Distinct commands with their probability of failure, 0 where unknown, and place in the plan."""
    known = steps.select("command").distinct().join(probability.select(F.col("test_file").alias("command"), "probability"), "command", "left")
    known = known.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return known.withColumn("place", F.row_number().over(W.orderBy(F.desc("probability"), "command")))


def rule_scores(predictions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """file and the greatest weight of its reasons; unknown reasons weigh 0."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return predictions.groupBy("file").agg(F.max(F.coalesce(F.try_element_at(table, F.col("reason")), F.lit(0.0))).alias("rule_score"))


def blend(rules: DataFrame, semantic: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - w) rule + w semantic for each file of either side; with weight 0 the rules alone."""
    if not weight:
        return rules.select("file", F.round("rule_score", 6).alias("score"))
    both = rules.join(semantic, "file", "full")
    return both.select("file", F.round((1 - weight) * F.coalesce("rule_score", F.lit(0.0)) + weight * F.coalesce("semantic_score", F.lit(0.0)), 6).alias("score"))


def semantic_basis(outcomes: DataFrame, similar: DataFrame) -> DataFrame:
    """test_file, failures, total, mean similarity and mean similarity of failures, over similar diffs."""
    rows = outcomes.join(similar, "diff_id")
    return rows.groupBy("test_file").agg(
        F.count_if("failed").alias("failures"), F.count("*").alias("total"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.avg(F.when(F.col("failed"), F.col("similarity"))), 6).alias("failed_similarity")
    )


def snapshot_totals(snapshots: DataFrame, ts: str, newest: int) -> DataFrame:
    """Rows of each snapshot, newest first."""
    return snapshots.groupBy(ts).agg(F.count("*").alias("total")).orderBy(F.desc(ts)).limit(newest)


def delta_percent(totals: DataFrame, ts: str) -> DataFrame:
    """Change of the total from one snapshot to the next in percent, two decimals; null after 0 and for the first.

    The totals are few: one row for each snapshot.
    """
    before = F.lag("total").over(W.orderBy(ts))
    return totals.withColumn("before", before).withColumn("delta", F.when(F.col("before") != 0, F.round((F.col("total") - F.col("before")) / F.col("before") * 100, 2)))


def health(runs: DataFrame, newest: int) -> DataFrame:
    """Runs, pass rate, last time and last result of the newest runs; one row."""
    rows = last_runs(runs, newest)
    return rows.agg(F.count("*").alias("runs"), F.round(F.avg(F.col("overall_pass").cast("int")), 6).alias("pass_rate"), F.max("ts").alias("last_ts"), F.max_by("overall_pass", F.struct("ts", "run_id")).alias("last_pass"))


def usage(events: DataFrame, kind: str, ts: str) -> DataFrame:
    """Uses and active days of each kind."""
    return events.groupBy(kind).agg(F.count("*").alias("uses"), F.count_distinct(F.to_date(ts)).alias("active_days"))


def freshness(files: DataFrame, as_of: str) -> DataFrame:
    """Index freshness: counts by state, newest indexing and its age in days; one row."""
    newest = F.max("last_indexed_at")
    return files.agg(
        F.count("*").alias("files"), F.count_if(F.col("parse_status") == "OK").alias("ok"), F.count_if(F.col("parse_status") == "PARSE_FAILED").alias("failed"), F.count_if(F.col("parse_status") == "DELETED").alias("deleted"), newest.alias("newest"), F.datediff(F.lit(as_of).cast("date"), F.to_date(newest)).alias("age_days")
    )
