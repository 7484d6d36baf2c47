"""Queries over command timings, verification runs and test outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.operators import timings as t
from loomgrain.sources import roles
from loomgrain.sources.roles import with_sql
from loomgrain.sources.tables import table

AS_OF = "2024-01-31 00:00:00"
WEIGHTS = {"temporal": 0.80, "call_graph": 0.70, "runtime": 0.65, "structural": 0.60, "test_mapping": 0.50}


def _predictions(s, d):
    """A file with the reasons for which it is predicted."""
    n = F.col("l_linenumber") % 6
    names = F.array(*map(F.lit, [*WEIGHTS, "other"]))
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.get(names, n).alias("reason"))


def _semantic(s, d):
    rows = table(s, d, "embeddings")
    return rows.groupBy((F.col("label") * 11 + F.col("vec_id") % 13).alias("file")).agg(F.round(F.avg(F.abs(F.get("embedding", F.lit(0)).cast("double"))), 6).alias("semantic_score"))


def _trend_rows(s, d):
    """Snapshots of hotspot scores: one per shipping day."""
    return table(s, d, "lineitem").select(F.col("l_shipdate").alias("recorded_at"), F.col("l_suppkey").alias("file"), (F.col("l_discount") / 10).alias("score"))


def week_trend(s, d):
    return t.week_over_week(roles.timings(s, d), AS_OF)


def similar_outcomes(s, d):
    similar = table(s, d, "embeddings").select((F.col("vec_id") * 3).alias("diff_id"), F.abs(F.get("embedding", F.lit(1)).cast("double")).alias("similarity"))
    return t.semantic_basis(roles.outcomes(s, d), similar)


def ci_failure_scores(s, d):
    """Mean similarity of each CI job's failed outcomes; jobs without a failure are absent."""
    similar = table(s, d, "embeddings").select(F.col("vec_id").alias("diff_embedding_id"), F.abs(F.get("embedding", F.lit(2)).cast("double")).alias("similarity"))
    rows = table(s, d, "ci_outcome_history").filter("outcome = 'fail'").join(similar, "diff_embedding_id")
    return rows.groupBy("job_name").agg(F.round(F.avg("similarity"), 6).alias("score"), F.count("*").alias("n"))


QUERIES = {
    "timings_filtered": lambda s, d: t.select_timings(roles.timings(s, d), inner=False, command="click", since="2024-01-10", limit=50).select("event_id", "duration_ms"),
    "percentile_ranks": lambda s, d: t.percentile_ranks(roles.timings(s, d), ["command", "repo"], "duration_ms", (50, 95, 99)),
    "command_summary": lambda s, d: t.command_summary(roles.timings(s, d), 20),
    "inner_spans": lambda s, d: t.inner_spans(roles.timings(s, d), 500),
    "pooled_summary": lambda s, d: t.pooled_summary(roles.timings(s, d)),
    "span_cardinality": lambda s, d: t.span_cardinality(roles.timings(s, d), 9),
    "daily_rollup": lambda s, d: t.daily_rollup(_trend_rows(s, d)),
    "week_over_week": week_trend,
    "retained_timings": lambda s, d: t.retained(roles.timings(s, d), AS_OF, 20, 5).select("event_id"),
    "verification_trend": lambda s, d: t.verification_trend(roles.runs(s, d)),
    "step_stats": lambda s, d: t.step_stats(roles.steps(s, d), roles.runs(s, d), 200),
    "recent_run_steps": lambda s, d: roles.steps(s, d).join(t.last_runs(roles.runs(s, d), 50).select("run_id"), "run_id", "left_semi").select("run_id", "command", "step", "failed"),
    "failure_probability": lambda s, d: t.failure_probability(roles.outcomes(s, d)),
    "ordered_steps": lambda s, d: t.ordered_steps(roles.steps(s, d), t.failure_probability(roles.outcomes(s, d), 30)),
    "rule_scores": lambda s, d: t.rule_scores(_predictions(s, d), WEIGHTS),
    "blended_scores": lambda s, d: t.blend(t.rule_scores(_predictions(s, d), WEIGHTS), _semantic(s, d)),
    "similar_outcomes": similar_outcomes,
    "ci_failure_scores": ci_failure_scores,
    "snapshot_totals": lambda s, d: t.snapshot_totals(_trend_rows(s, d), "recorded_at", 14),
    "hotspot_delta": lambda s, d: t.delta_percent(t.snapshot_totals(_trend_rows(s, d), "recorded_at", 14), "recorded_at"),
    "verify_health": lambda s, d: t.health(roles.runs(s, d), 100),
    "usage_days": lambda s, d: t.usage(table(s, d, "events"), "event_type", "ts"),
    "index_freshness": lambda s, d: t.freshness(table(s, d, "project_files"), "2019-07-01"),
}


_PCTS = ", ".join(f"list_sort(list(duration_ms))[cast(round({p / 100} * (count(*) - 1)) as bigint) + 1] as p{p}" for p in (50, 95, 99))
_TREND = "trend as (select l_shipdate as recorded_at, l_suppkey as file, l_discount / 10 as score from lineitem)"
_PROB = """diffs as (select diff_id from outcomes group by 1 order by max(recorded_at) desc, diff_id desc limit {n}),
rows_ as (select * from outcomes where diff_id in (select diff_id from diffs)),
prob as (select test_file, count(*) runs, count(*) filter (failed) fails, round((count(*) filter (failed) + 1) / (count(*) + 2), 6) probability from rows_ group by 1
  having (select count(distinct diff_id) from rows_) >= 10 and (select count(*) from rows_ where failed) > 0)"""
_RULES = "rules as (select l_suppkey as file, max(case l_linenumber % 6 when 0 then 0.8 when 1 then 0.7 when 2 then 0.65 when 3 then 0.6 when 4 then 0.5 else 0 end)::double as rule_score from lineitem group by 1)"
ORACLES = {
    "timings_filtered": with_sql("timings", "select event_id, duration_ms from timings where span_name is null and command = 'click' and ts >= '2024-01-10' order by ts desc, event_id desc limit 50"),
    "percentile_ranks": with_sql("timings", f"select command, repo, {_PCTS} from timings group by all"),
    "command_summary": with_sql("timings", f"select command, count(*) as runs, sum(duration_ms)::bigint as total, {_PCTS} from timings where span_name is null group by 1 order by total desc, command limit 20"),
    "inner_spans": with_sql("timings", "+ n as (select * from timings where span_name is not null order by ts desc, event_id desc limit 500) select command, span_name, count(*) n, sum(duration_ms)::bigint total, max(duration_ms) longest from n group by all"),
    "pooled_summary": with_sql("timings", "select repo, command, grouping(repo)::int as pooled, count(*) as runs, sum(duration_ms)::bigint as total, max(duration_ms) as longest from timings where span_name is null group by grouping sets ((command), (repo, command))"),
    "span_cardinality": with_sql("timings", "select command, count(distinct span_name) as spans, count(distinct span_name) > 9 as over from timings group by 1"),
    "daily_rollup": f"with {_TREND} select cast(recorded_at as date) as day, round(least(greatest(20 * avg(ln(1 + 1000 * score)), 0), 100), 6) project_score, count(*) files, count(*) filter (ln(1 + 1000 * score) >= 3.0) high_risk from trend where recorded_at in (select max(recorded_at) from trend group by cast(recorded_at as date)) group by 1",
    "week_over_week": with_sql(
        "timings",
        f"""+ r as (select *, ts >= timestamp '{AS_OF}' - interval 7 day wk, row_number() over (partition by command order by ts desc, event_id desc) k from timings
  where span_name is null and ts >= timestamp '{AS_OF}' - interval 14 day and ts <= timestamp '{AS_OF}'),
m as (select command, avg(duration_ms) filter (wk and k <= 100) a, avg(duration_ms) filter (not (wk and k <= 100) and k <= 200) b from r where k <= 200 group by 1),
e as (select command, round(a, 6) recent, round(b, 6) previous, round((a - b) / nullif(b, 0) * 100, 6) delta_percent from m)
select *, case when delta_percent is null then 'unknown' when abs(delta_percent) <= 1 then 'flat' when delta_percent > 0 then 'up' else 'down' end as trend from e""",
    ),
    "retained_timings": with_sql("timings", f"select event_id from timings where ts >= timestamp '{AS_OF}' - case when span_name is null then interval 20 day else interval 5 day end"),
    "verification_trend": with_sql("runs", "select cast(ts as date) as day, count(*) filter (overall_pass) passed, count(*) filter (not overall_pass) failed from runs group by 1"),
    "step_stats": with_sql(
        "runs steps",
        "+ rec as (select run_id from runs order by ts desc, run_id desc limit 200), a as (select command, count(*) runs, count(*) filter (failed) failures, round(avg(duration_ms), 6) mean_ms, max(ts) last_ts from steps join runs using (run_id) group by 1), "
        "b as (select command, count(*) filter (failed) n from steps where run_id in (select run_id from rec) group by 1) select a.*, coalesce(n, 0) recent_failures from a left join b using (command)",
    ),
    "recent_run_steps": with_sql("runs steps", "select run_id, command, step, failed from steps where run_id in (select run_id from runs order by ts desc, run_id desc limit 50)"),
    "failure_probability": with_sql("outcomes", f"+ {_PROB.format(n=1000)} select * from prob"),
    "ordered_steps": with_sql("outcomes steps", f"+ {_PROB.format(n=30)}, k as (select distinct command from steps), j as (select command, coalesce(probability, 0) probability from k left join prob on test_file = command) select *, row_number() over (order by probability desc, command) as place from j"),
    "rule_scores": f"with {_RULES} select * from rules",
    "blended_scores": f"with {_RULES}, sem as (select label * 11 + vec_id % 13 as file, round(avg(abs(embedding[1]::double)), 6) semantic_score from embeddings group by 1) select file, round(0.7 * coalesce(rule_score, 0) + 0.3 * coalesce(semantic_score, 0), 6) as score from rules full join sem using (file)",
    "similar_outcomes": with_sql("outcomes", "+ sim as (select vec_id * 3 as diff_id, abs(embedding[2]::double) similarity from embeddings) select test_file, count(*) filter (failed) failures, count(*) total, round(avg(similarity), 6) mean_similarity, round(avg(similarity) filter (failed), 6) failed_similarity from outcomes join sim using (diff_id) group by 1"),
    "ci_failure_scores": "select job_name, round(avg(abs(embedding[3]::double)), 6) as score, count(*) as n from ci_outcome_history join embeddings on vec_id = diff_embedding_id where outcome = 'fail' group by 1",
    "snapshot_totals": f"with {_TREND} select recorded_at, count(*) as total from trend group by 1 order by 1 desc limit 14",
    "hotspot_delta": f"with {_TREND}, n as (select recorded_at, count(*) as total from trend group by 1 order by 1 desc limit 14), b as (select *, lag(total) over (order by recorded_at) as before from n) select *, round((total - before) / nullif(before, 0) * 100, 2) as delta from b",
    "verify_health": with_sql("runs", "+ n as (select * from runs order by ts desc, run_id desc limit 100) select count(*) runs, round(avg(overall_pass::int), 6) pass_rate, max(ts) last_ts, arg_max(overall_pass, (ts, run_id)) last_pass from n"),
    "usage_days": "select event_type, count(*) as uses, count(distinct cast(ts as date)) as active_days from events group by 1",
    "index_freshness": "select count(*) files, count(*) filter (parse_status = 'OK') ok, count(*) filter (parse_status = 'PARSE_FAILED') failed, count(*) filter (parse_status = 'DELETED') deleted, max(last_indexed_at) newest, date_diff('day', max(last_indexed_at)::date, date '2019-07-01')::int age_days from project_files",
}

