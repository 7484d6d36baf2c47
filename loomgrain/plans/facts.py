"""Queries about files, symbols and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.functions import text as t
from loomgrain.operators import facts as f
from loomgrain.operators import nested, search
from loomgrain.operators import vectors as v
from loomgrain.sources import roles
from loomgrain.sources.roles import with_sql
from loomgrain.sources.tables import table

IGNORED = ("docs/**", "*.toml", "**/test_*", "tools/?*/cap_*")
RULES = (("src/ledger/**", "strict"), ("**/*.sql", "review"), ("docs/**", "advise"))
AS_OF = "2019-07-01"
OBSERVED = {"errors": "(?i)error", "retries": "(?i)retr(?:y|ies)", "timings": "[0-9]+ ms"}


def _files(s, d):
    return table(s, d, "project_files")


def _path():
    return F.col("file_path")


def latest_packets(s, d):
    """The newest snapshot of each branch whose packet is complete JSON, with the packet's digest."""
    rows = table(s, d, "snapshots").filter("branch_name is not null").filter(F.try_parse_json("packet_json").isNotNull())
    newest = F.max(F.struct(F.col("timestamp_utc").alias("at"), "id", F.md5("packet_json").alias("packet")))
    return rows.groupBy("branch_name").agg(newest.alias("x")).select("branch_name", "x.id", "x.at", "x.packet")


def packet_languages(s, d):
    """Changed files of all packets by language and by whether they are known."""
    found = nested.flat_table(nested.shred(table(s, d, "snapshots").filter("id is not null and packet_json is not null"), "id", "packet_json", owners=frozenset([nested.PACKET.tables["change"]])), "change")
    joined = found.join(_files(s, d).select(F.col("file_path").alias("path"), "language"), "path", "left")
    return joined.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.count_distinct("__id").alias("snapshots"))


def retrieved(s, d):
    """Texts of the best matches: three times as many vectors as wanted, then only those that have a text."""
    found = v.similar_to(table(s, d, "embeddings"), [1.0] * 64, 30)
    return found.join(table(s, d, "documents").filter("text <> ''").select(F.col("doc_id").alias("id"), "heading"), "id").orderBy(F.desc("similarity"), "id").limit(10)


def endpoints(s, d):
    """Jobs with their configuration's file where it is known, and whether it still exists."""
    jobs = table(s, d, "ci_outcome_history").select("job_name", "ci_file_id").distinct()
    return jobs.join(_files(s, d).select(F.col("id").alias("ci_file_id"), "file_path", "parse_status"), "ci_file_id", "left").select("job_name", "ci_file_id", "file_path", F.coalesce(F.col("parse_status") == "DELETED", F.lit(False)).alias("stale"))


def edge_union(s, d):
    e = roles.calls(s, d)
    return e.filter("relation = 'calls'").select("source", "target").union(e.filter("relation = 'tests'").select("source", "target")).distinct()


def edge_difference(s, d):
    e = roles.calls(s, d)
    return e.filter("relation = 'calls'").select("source", "target").subtract(e.filter("relation = 'tests'").select("source", "target"))


def staleness(s, d):
    return f.ages(_files(s, d), AS_OF).select("id", "days", t.staleness_tier(F.col("days"), 60).alias("tier"))


QUERIES = {
    "kept_paths": lambda s, d: _files(s, d).filter(~f.matches_any(_path(), IGNORED)).select("id"),
    "policy_modes": lambda s, d: _files(s, d).select("id", f.first_rule(_path(), RULES, "free").alias("mode")),
    "json_field": lambda s, d: table(s, d, "events").filter(f.json_field("props", "$.k").cast("int").isin(1, 2, 3)).select("event_id"),
    "log_tails": lambda s, d: f.tail(search.lines(table(s, d, "documents").filter("source = 'ci_log'")), "doc_id", "line_no", 5).select("doc_id", "line_no"),
    "latest_packets": latest_packets,
    "packet_languages": packet_languages,
    "named_calls": lambda s, d: f.with_names(roles.calls(s, d), roles.symbols(s, d).filter("kind <> 'SMALL'")),
    "callers_of": lambda s, d: f.callers_of(roles.calls(s, d), roles.symbols(s, d), "red widget"),
    "callees_of": lambda s, d: f.callees_of(roles.calls(s, d), roles.symbols(s, d), "red widget"),
    "missing_interfaces": lambda s, d: f.missing_interfaces(table(s, d, "test_mapping").select(F.col("tested_file_id").alias("id")), _files(s, d).filter("deleted_at is null"), "id"),
    "test_names": lambda s, d: f.test_names(_files(s, d)),
    "staleness": staleness,
    "service_summary": lambda s, d: f.service_summary(_files(s, d), "service_name"),
    "config_and_source": lambda s, d: f.config_and_source(table(s, d, "transactions"), "session_id", "entity", F.endswith(F.col("entity"), F.lit(".yml"))),
    "file_nodes": lambda s, d: f.file_nodes(_files(s, d)),
    "test_edges": lambda s, d: f.test_edges(table(s, d, "test_mapping"), _files(s, d)),
    "observed_patterns": lambda s, d: f.pattern_counts(table(s, d, "documents"), "source", "text", OBSERVED),
    "retrieved": retrieved,
    "endpoints": endpoints,
    "edge_union": edge_union,
    "edge_difference": edge_difference,
}

_IGNORED = "|".join(map(f.glob_pattern, IGNORED))
ORACLES = {
    "kept_paths": f"select id from project_files where not regexp_matches(file_path, '{_IGNORED}')",
    "policy_modes": "select id, case when starts_with(file_path, 'src/ledger/') then 'strict' when ends_with(file_path, '.sql') then 'review' when starts_with(file_path, 'docs/') then 'advise' else 'free' end as mode from project_files",
    "json_field": "select event_id from events where (props->>'$.k')::int in (1, 2, 3)",
    "log_tails": "select doc_id, i as line_no from (select doc_id, len(string_split(text, chr(10))) n from documents where source = 'ci_log' and text is not null), unnest(generate_series(greatest(1, n - 4), n)) u(i)",
    "latest_packets": "select branch_name, arg_max(id, (timestamp_utc, id)) as id, max(timestamp_utc) as at, md5(arg_max(packet_json, (timestamp_utc, id))) as packet from snapshots where branch_name is not null and json_valid(packet_json) group by 1",
    "named_calls": with_sql("calls symbols", "select source, coalesce(name, 'unresolved:' || target) as callee, name is not null as resolved from calls left join (select * from symbols where kind <> 'SMALL') on symbol_id = target"),
    "callers_of": with_sql("calls symbols", "select symbol_id, name from symbols where symbol_id in (select source from calls where target in (select symbol_id from symbols where name = 'red widget'))"),
    "callees_of": with_sql("calls symbols", "select symbol_id, name from symbols where symbol_id in (select target from calls where source in (select symbol_id from symbols where name = 'red widget'))"),
    "missing_interfaces": "select tested_file_id as id, count(*) as uses, case when tested_file_id in (select id from project_files where deleted_at is null) then 'available' else 'removed' end as state from test_mapping where tested_file_id is not null group by 1",
    "test_names": r"with b as (select id, language, regexp_extract(file_path, '([^/]+?)(?:\.[^./]+)?$', 1) as base from project_files), c as (select *, regexp_replace(base, '^test_|_test$', '', 'g') as bare from b where base <> '') select x.id as test_file_id, y.id as tested_file_id from c x join c y on x.bare = y.base and x.language = y.language where x.base <> x.bare",
    "staleness": f"with a as (select id, case when date_diff('day', make_timestamp(mtime_ns // 1000)::date, date '{AS_OF}') < 30 then null else date_diff('day', greatest(make_timestamp(mtime_ns // 1000), last_indexed_at, loaded_at)::date, date '{AS_OF}') end::int as days from project_files) select *, case when days < 60 then null when days <= 120 then 'warning' when days is not null then 'critical' end as tier from a",
    "service_summary": "select service_name, count(*) as files, coalesce(string_agg(distinct language, ',' order by language), '') as languages, min(file_path) as first from project_files where service_name is not null group by 1",
    "config_and_source": "select session_id, bool_or(ends_with(entity, '.yml')) as config, bool_or(not ends_with(entity, '.yml')) as source from transactions where entity is not null group by 1",
    "file_nodes": "select 'urn:repo:file:' || replace(file_path, '\\', '/') as node, 'file' as category, file_path as label from project_files where parse_status is null or parse_status <> 'DELETED'",
    "test_edges": "select a.file_path as source, b.file_path as target, 'validates' as relation, max(confidence) as confidence from test_mapping m join project_files a on a.id = m.test_file_id join project_files b on b.id = m.tested_file_id group by m.test_file_id, m.tested_file_id, 1, 2",
    "observed_patterns": "select source, sum(len(regexp_extract_all(text, '(?i)error')))::bigint as errors, sum(len(regexp_extract_all(text, '(?i)retr(?:y|ies)')))::bigint as retries, sum(len(regexp_extract_all(text, '[0-9]+ ms')))::bigint as timings from documents where text is not null group by 1",
    "retrieved": "with e as (select vec_id as id, embedding::double[] em, list_transform(generate_series(1, 64), lambda i: 1.0::double) q from embeddings), k as (select id, round(least(greatest(list_dot_product(em, q) / (sqrt(list_dot_product(em, em)) * 8), -1), 1), 6) as similarity from e order by 2 desc, 1 limit 30) select id, similarity, heading from k join documents on doc_id = id where text <> '' order by similarity desc, id limit 10",
    "endpoints": "select distinct job_name, ci_file_id, file_path, coalesce(parse_status = 'DELETED', false) as stale from ci_outcome_history c left join project_files f on f.id = c.ci_file_id",
    "edge_union": with_sql("calls", "select source, target from calls where relation = 'calls' union select source, target from calls where relation = 'tests'"),
    "edge_difference": with_sql("calls", "select source, target from calls where relation = 'calls' except select source, target from calls where relation = 'tests'"),
}
