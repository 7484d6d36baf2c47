"""Queries over the change history."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.operators import history as h
from loomgrain.sources import roles
from loomgrain.sources.roles import with_sql
from loomgrain.sources.tables import table


def _frequency(s, d):
    return h.decayed_frequency(roles.commit_files(s, d), roles.commits(s, d))


def _hot(s, d):
    return h.hotspots(_frequency(s, d), h.file_complexity(roles.symbols(s, d)))


def _files(s, d):
    return h.eligible_files(roles.commit_files(s, d), h.recent_commits(roles.commits(s, d), 1000))


def _coupling(s, d, threshold=0.2):
    return h.temporal_coupling(_files(s, d), threshold=threshold)


def _trends(s, d):
    """Hotspot snapshots: a file's score on each day."""
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_shipdate").alias("recorded_at")).agg(F.round(F.sum("l_quantity") / 100, 4).alias("score"))


def latest_snapshot(s, d):
    return h.latest_snapshot(_trends(s, d)).select("file", "score")


def budget_violations(s, d):
    return h.latest_snapshot(_trends(s, d)).filter(F.col("score") > 0.3).select("file", "score")


def snapshot_changes(s, d):
    return h.changed_snapshots(_trends(s, d), "file", "recorded_at", "score")


def hotspots_under_path(s, d):
    """Path filters pushed into the scan: exact file, folder prefix, suffix."""
    files = table(s, d, "project_files")
    return files.filter((F.col("file_path") == "HISTORY.md") | F.col("file_path").startswith("src/ledger/") | F.col("file_path").endswith(".toml")).select("id", "file_path")


def boosted_hotspots(s, d):
    central = roles.symbols(s, d).select("file", F.col("cognitive").alias("reachable"), (F.col("cyclomatic") / 37).alias("rank"))
    return h.centrality_boost(_hot(s, d), central).select("file", "boosted")


QUERIES = {
    "decayed_frequency": lambda s, d: _frequency(s, d).withColumn("frequency", F.round("frequency", 6)),
    "file_complexity": lambda s, d: h.file_complexity(roles.symbols(s, d)),
    "hotspots": _hot,
    "top_hotspots": lambda s, d: h.top(_hot(s, d), "score", "file", 10),
    "boosted_hotspots": boosted_hotspots,
    "file_revisions": lambda s, d: h.revisions(_files(s, d), 100).withColumn("weight", F.round("weight", 6)),
    "temporal_coupling": _coupling,
    "coupling_of_changed": lambda s, d: h.couplings_of(_coupling(s, d), s.range(1, 20).select(F.col("id").alias("file"))),
    "commit_ordinals": lambda s, d: h.recent_commits(roles.commits(s, d), 500).select("commit_id", "ord"),
    "commits_since": lambda s, d: h.recent_commits(roles.commits(s, d), 500, since_ts="2001-06-01", stop_at=0).select("commit_id", "ord"),
    "last_change": lambda s, d: h.last_change(roles.change_log(s, d), roles.commits(s, d)),
    "latest_snapshot": latest_snapshot,
    "budget_violations": budget_violations,
    "snapshot_changes": snapshot_changes,
    "daily_changes": lambda s, d: h.day_buckets(roles.commits(s, d), "ts", "1999-03-31", 90, F.lit(1), "commits"),
    "path_filters": hotspots_under_path,
}

_RECENT = "recent as (select commit_id, ts, is_merge, row_number() over (order by ts desc, commit_id) - 1 as ord from commits qualify ord < {n})"
_FREQ = _RECENT.format(n=500) + """,
files as (select distinct commit_id, file, ord from change_log join recent using (commit_id) where not recent.is_merge),
freq as (select file, sum(pow(2.0, -ord / 100.0)) frequency, count(*) changes from files group by file)"""
_COMPLEX = "comp as (select file, max(greatest(cognitive, cyclomatic)) complexity from symbols group by file)"
_HOT = f"""{_FREQ}, {_COMPLEX},
j as (select file, frequency, coalesce(complexity, 0) complexity from freq left join comp using (file)),
m as (select greatest(max(frequency), 1.0) max_f, greatest(max(complexity), 1) max_c from j),
hot as (select file, round(frequency, 6) frequency, complexity, round(frequency / max_f * complexity / max_c, 6) score,
  round(ln(1 + 1000 * (frequency / max_f * complexity / max_c)), 6) display_score,
  case when frequency / max_f > 0.5 and complexity / max_c > 0.5 then 'critical' when frequency / max_f > 0.5 then 'volatile' when complexity / max_c > 0.5 then 'complex' else 'calm' end risk_class from j, m)"""
_PAIRS = _RECENT.format(n=1000) + """,
f0 as (select distinct commit_id, file, ord as walk from change_log join recent using (commit_id) where not recent.is_merge),
sizes as (select commit_id, walk, count(*) n from f0 group by all having n between 1 and 50),
ords as (select commit_id, row_number() over (order by walk) - 1 as ord from sizes),
files as (select commit_id, file, ord from f0 join ords using (commit_id)),
rev as (select file, count(*) n, sum(pow(2.0, -ord / 100.0)) weight from files group by file having count(*) >= 5),
pairs as (select a.file f, b.file g, count(*) shared, sum(pow(2.0, -a.ord / 100.0)) tog from files a join files b on a.commit_id = b.commit_id and a.file < b.file
  where a.file in (select file from rev) and b.file in (select file from rev) group by all having count(*) >= 3),
ways as (select f file_a, g file_b, shared, tog from pairs union all select g, f, shared, tog from pairs),
coup as (select file_a, file_b, shared, round(tog / weight, 6) score from ways join rev on file = file_a)"""
_TRENDS = "trends as (select l_suppkey as file, l_shipdate as recorded_at, round(sum(l_quantity) / 100, 4) as score from lineitem group by all)"
_V = "change_log commits symbols"
ORACLES = {
    "decayed_frequency": with_sql(_V, f"+{_FREQ} select file, round(frequency, 6) frequency, changes from freq"),
    "file_complexity": with_sql(_V, f"+{_COMPLEX} select * from comp"),
    "hotspots": with_sql(_V, f"+{_HOT} select * from hot"),
    "top_hotspots": with_sql(_V, f"+{_HOT} select * from hot order by score desc, file limit 10"),
    "boosted_hotspots": with_sql(_V, f"+{_HOT} select file, round(score + 0.1 * ln(1 + coalesce(max(cognitive), 0)) + 0.3 * coalesce(max(cyclomatic / 37), 0), 6) boosted from hot left join symbols using (file) group by file, score"),
    "file_revisions": with_sql(_V, f"+{_PAIRS} select file, n, round(weight, 6) weight from rev"),
    "temporal_coupling": with_sql(_V, f"+{_PAIRS} select * from coup where score > 0.2"),
    "coupling_of_changed": with_sql(_V, f"+{_PAIRS} select * from coup where score > 0.2 and (file_a between 1 and 19 or file_b between 1 and 19) order by score desc, file_a, file_b limit 50"),
    "commit_ordinals": with_sql(_V, f"+{_RECENT.format(n=500)} select commit_id, ord from recent"),
    "commits_since": with_sql(
        _V,
        "+ r as (select commit_id, row_number() over (order by ts desc, commit_id) - 1 as ord from commits where ts >= '2001-06-01' qualify ord < 500) select * from r where ord < coalesce((select min(ord) from r where commit_id = 0), 1000000)",
    ),
    "last_change": with_sql(_V, "select file, max(c.ts) last_ts, arg_max(author, (c.ts, -commit_id)) last_author from change_log join commits c using (commit_id) group by file"),
    "latest_snapshot": f"with {_TRENDS} select file, score from trends where recorded_at = (select max(recorded_at) from trends)",
    "budget_violations": f"with {_TRENDS} select file, score from trends where recorded_at = (select max(recorded_at) from trends) and score > 0.3",
    "snapshot_changes": f"with {_TRENDS}, p as (select recorded_at, count(*) n, list((file, score) order by file) l from trends group by 1), q as (select *, lag(l) over (order by recorded_at) b from p) select recorded_at, n from q where b is null or b <> l",
    "daily_changes": "select cast(g as date) as day, count(o_orderkey) as commits from generate_series(date '1999-01-01', date '1999-03-31', interval 1 day) t(g) left join orders on cast(o_orderdate as date) = cast(g as date) group by 1",
    "path_filters": "select id, file_path from project_files where file_path = 'HISTORY.md' or starts_with(file_path, 'src/ledger/') or ends_with(file_path, '.toml')",
}
