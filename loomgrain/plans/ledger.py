"""Queries over ledger, sync and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.operators import ledger as l
from loomgrain.operators import risk as r
from loomgrain.operators import search
from loomgrain.sources import roles
from loomgrain.sources.roles import with_sql
from loomgrain.sources.tables import table

AS_OF = "2019-06-15 00:00:00"
WEIGHTS = {"rs": 1.0, "py": 0.9, "ts": 0.8, "sql": 0.7, "toml": 0.4, "md": 0.1}


def _once(s, d):
    """Each ledger entry once: the earliest load."""
    rows = table(s, d, "ledger_entries").filter("id is not null")
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "loaded_at").alias("x")).select("id", "x.*")


def _tx(s, d):
    return table(s, d, "transactions").select("tx_id", "status", "entity", "started_at", "loaded_at", "drift_count")


def posture(s, d):
    """Sources by how much is open, worst first."""
    rows = l.latest(table(s, d, "transactions").select("tx_id", "source", "status", "loaded_at", "drift_count", "detected_at"), ["tx_id"], ["loaded_at"])
    sums = rows.groupBy("source").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.sum(F.coalesce("drift_count", F.lit(0))).alias("drift"), F.max("detected_at").alias("last_detected"))
    return sums.orderBy(F.desc("pending"), F.desc("drift"), F.asc_nulls_last("last_detected"))


def tx_stats(s, d):
    """Transactions with the numbers of their entries and of verified ones, 0 where there are none."""
    entries = _once(s, d).groupBy("tx_id").agg(F.count("*").alias("n"), F.count_if(F.col("verification_status") == "VERIFIED").alias("v"))
    return _tx(s, d).select("tx_id").distinct().join(entries, "tx_id", "left").select("tx_id", F.coalesce("n", F.lit(0)).alias("entries"), F.coalesce("v", F.lit(0)).alias("verified"))


def merged(s, d):
    """Last-writer-wins over transactions and tombstones; a row's clock is its load time."""
    rows = table(s, d, "transactions").select(F.lower(F.trim("tx_id")).alias("tx_id"), "status", "loaded_at")
    written = F.struct(F.unix_millis(F.col("loaded_at").cast("timestamp")).alias("physical"), F.lit(0).alias("counter"), F.lit("").alias("node"))
    graves = table(s, d, "tx_tombstones").select(F.lower(F.trim("tx_id")).alias("tx_id"), "tombstone_hlc")
    return l.last_writer(rows, "tx_id", F.when(F.col("loaded_at").isNotNull(), written), graves, l.clock(F.col("tombstone_hlc"))).select("tx_id", "status")


def embedding_upsert(s, d):
    """Vectors against a newer delivery in which one label changed and one is missing."""
    rows = table(s, d, "embeddings").select("vec_id", F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))), 256).alias("hash"), "label")
    newer = rows.filter("label <> 2").withColumn("hash", F.when(F.col("label") == 5, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return l.upsert(rows.filter("label <> 7"), newer, "vec_id", "hash").groupBy("action").agg(F.count("*").alias("n"))


def risk_levels(s, d):
    """Transactions by the weights of what their entries say, from several providers."""
    entries = _once(s, d).select("tx_id", "is_breaking", "risk", "entity", "verification_status").filter("tx_id is not null")
    registry = (
        r.Registry()
        .add("breaking", lambda c: c["e"].filter("is_breaking").select(F.col("tx_id").alias("key"), F.lit("breaking change").alias("reason"), F.lit(30).alias("weight")))
        .add("stated", lambda c: c["e"].filter("risk is not null").select(F.col("tx_id").alias("key"), F.col("risk").alias("reason"), F.when(F.upper("risk") == "HIGH", 40).when(F.upper("risk") == "MEDIUM", 15).otherwise(0).alias("weight")))
        .add("kind", lambda c: c["e"].filter("entity is not null").select(F.col("tx_id").alias("key"), F.lit("kind of file").alias("reason"), (10 * r.extension_weight(F.col("entity"), WEIGHTS)).alias("weight")))
    )
    return r.levels(registry.run({"e": entries})[0])


def dead_code(s, d):
    mapped = table(s, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat("p_name", F.when(F.col("p_size") > 40, "Record").otherwise("")).alias("name"), F.when(F.col("p_type") == "PROMO", "Debug,Clone").alias("derives"), (F.col("p_size") % 2).alias("unreachable"), (F.col("p_size") / 50).alias("inactive"), (F.col("p_size") % 3 % 2).alias("untested"))
    return r.dead_code(mapped, ("Provider", "Result", "Chunk", "Record"), ("Serialize", "Debug"))


def anomalies(s, d):
    found = r.log_anomalies(search.lines(table(s, d, "documents").filter("source = 'ci_log'")), "doc_id", "line_no", "line", "(?i)error|failed|panic")
    return found.select("label", "n", "severity", F.md5("excerpt").alias("excerpt"))


def signals(s, d):
    """Jobs by the severity of their durations."""
    rows = table(s, d, "ci_outcome_history").filter("duration_ms is not null")
    return r.elevation(rows.select("job_name", F.when(F.col("duration_ms") > 10_000_000, "critical").when(F.col("duration_ms") > 1_000_000, "warning").otherwise("normal").alias("severity")), "job_name", "severity")


def module_dependencies(s, d):
    """How many other folders' files each folder's tests cover."""
    files = table(s, d, "project_files").select("id", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("folder"))
    maps = table(s, d, "test_mapping").select("test_file_id", "tested_file_id")
    a, b = files.select(F.col("id").alias("test_file_id"), F.col("folder").alias("source")), files.select(F.col("id").alias("tested_file_id"), F.col("folder").alias("target"))
    return maps.join(a, "test_file_id").join(b, "tested_file_id").filter("source <> target").groupBy("source").agg(F.count_distinct("target").alias("targets"))


def declared_services(s, d):
    """Services that own files, that appear in jobs' paths, or both."""
    a = table(s, d, "project_files").filter("service_name is not null").select(F.col("service_name").alias("name"))
    b = table(s, d, "ci_outcome_history").select(F.concat(F.regexp_extract("job_name", "^[a-z]+-([a-z]+)", 1), F.lit("-svc")).alias("name")).filter("name <> '-svc'")
    return r.config_diff(a, b, "name")


QUERIES = {
    "ledger_velocity": lambda s, d: l.velocity(_once(s, d), AS_OF, 7),
    "top_churn": lambda s, d: l.top_churn(_once(s, d), "entity", 20),
    "drift_states": lambda s, d: l.state_counts(_tx(s, d), "status", ["PENDING", "COMMITTED", "ROLLED_BACK", "UNAUDITED"]),
    "compliance": lambda s, d: l.state_counts(_once(s, d), "verification_status", ["VERIFIED", "UNVERIFIED", "FAILED", "PARTIALLY_VERIFIED"], "category"),
    "latest_states": lambda s, d: l.latest(_tx(s, d), ["tx_id"], ["loaded_at"]).select("tx_id", "status", "drift_count"),
    "tx_by_prefix": lambda s, d: l.by_prefix(_tx(s, d), "tx_id", "7c").select("tx_id", "status"),
    "tx_of_file": lambda s, d: l.of_file(_tx(s, d), "entity", "keeper.rs").select("tx_id").distinct(),
    "ledger_page": lambda s, d: l.page(_once(s, d), [F.desc("committed_at"), F.col("id")], 40, 20).select("id", "committed_at"),
    "stale_pending": lambda s, d: l.stale(_tx(s, d), "started_at", AS_OF, 7, F.col("status") == "PENDING").select("tx_id", "started_at"),
    "last_writer": merged,
    "extract_since": lambda s, d: l.extract_since(_once(s, d), table(s, d, "tx_tombstones"), "2019-06-10", 100),
    "clocks": lambda s, d: table(s, d, "tx_tombstones").select(F.col("tx_id"), l.clock(F.col("tombstone_hlc")).alias("c")).select("tx_id", "c.physical", "c.counter", "c.node"),
    "entry_hashes": lambda s, d: _once(s, d).select("id", l.entry_hash(F.col("tx_id"), F.col("category"), F.col("summary")).alias("hash")),
    "open_entities": lambda s, d: l.upsert_counts(_tx(s, d), "entity", "started_at"),
    "embedding_upsert": embedding_upsert,
    "last_events": lambda s, d: l.last_meaningful(table(s, d, "events"), "user_id", "event_type", ["ts", "event_id"], "error"),
    "repo_posture": posture,
    "tx_stats": tx_stats,
    "risk_levels": risk_levels,
    "change_set_risk": lambda s, d: r.change_set_risk(table(s, d, "transactions").filter("session_id is not null"), "session_id", "entity", F.startswith(F.col("entity"), F.lit("src/ledger/")), 3, 6),
    "dead_code": dead_code,
    "log_anomalies": anomalies,
    "job_elevation": signals,
    "module_groups": lambda s, d: r.module_groups(table(s, d, "project_files"), "file_path"),
    "module_dependencies": module_dependencies,
    "service_diff": declared_services,
    "unknown_ci_files": lambda s, d: table(s, d, "ci_outcome_history").join(table(s, d, "project_files").select(F.col("id").alias("ci_file_id")), "ci_file_id", "left_anti").groupBy("ci_file_id").agg(F.count("*").alias("n")),
    "untested_files": lambda s, d: table(s, d, "project_files").select("id").join(table(s, d, "test_mapping").select(F.col("tested_file_id").alias("id")), "id", "left_anti"),
    "test_predictions": lambda s, d: table(s, d, "test_mapping").select("tested_file_id", "test_file_id").distinct().join(table(s, d, "project_files").filter("language = 'rust'").select(F.col("id").alias("tested_file_id")), "tested_file_id", "left_semi"),
    "test_predictions_all": lambda s, d: table(s, d, "test_mapping").select("tested_file_id", "test_file_id").distinct().join(table(s, d, "project_files").select(F.col("id").alias("tested_file_id")), "tested_file_id", "left_semi"),
    "files_by_mappings": lambda s, d: table(s, d, "project_files").select("id", "file_path").join(table(s, d, "test_mapping").groupBy(F.col("tested_file_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "id").limit(10),
    "structural_coupling": lambda s, d: roles.calls(s, d).join(roles.symbols(s, d).select(F.col("symbol_id").alias("source"), F.col("file").alias("from_file")), "source", "left").join(roles.symbols(s, d).filter("kind = 'PROMO'").select(F.col("symbol_id").alias("target"), F.col("file").alias("to_file")), "target").select("from_file", "to_file").filter("from_file is null or from_file <> to_file").distinct(),
    "hash_changes": lambda s, d: table(s, d, "project_files").select("file_path", "content_hash").join(table(s, d, "project_files").filter("parser_version = '2'").select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti"),
}

_ONCE = "once as (select * from ledger_entries where id is not null qualify row_number() over (partition by id order by loaded_at) = 1)"
_LATEST = "lt as (select * from transactions qualify row_number() over (partition by tx_id order by loaded_at desc nulls last) = 1)"
_HASH = "sha256('v2|' || strlen(coalesce(tx_id, '')) || ':' || coalesce(tx_id, '') || '|' || strlen(coalesce(category, '')) || ':' || coalesce(category, '') || '|' || strlen(coalesce(summary, '')) || ':' || coalesce(summary, ''))"
_CLOCK = "case when regexp_matches(trim(tombstone_hlc), '^(\\d{1,18})-(\\d{1,9})-(.+)$') then regexp_extract(trim(tombstone_hlc), '^(\\d{1,18})-(\\d{1,9})-(.+)$', %d) end"
_EXT = "case regexp_extract(entity, '\\.([^./]+)$', 1).lower() when 'rs' then 1.0 when 'py' then 0.9 when 'ts' then 0.8 when 'sql' then 0.7 when 'toml' then 0.4 when 'md' then 0.1 else 1.0 end"
ORACLES = {
    "ledger_velocity": f"with {_ONCE} select count(*) as entries from once where committed_at > timestamp '{AS_OF}' - interval 7 day and committed_at <= timestamp '{AS_OF}'",
    "top_churn": f"with {_ONCE} select entity, count(*) as n from once where entity is not null group by 1 order by 2 desc, 1 limit 20",
    "drift_states": "select " + ", ".join(f"count(*) filter (status = '{x}') as {x.lower()}" for x in ("PENDING", "COMMITTED", "ROLLED_BACK", "UNAUDITED")) + " from transactions",
    "compliance": f"with {_ONCE} select category, " + ", ".join(f"count(*) filter (verification_status = '{x}') as {x.lower()}" for x in ("VERIFIED", "UNVERIFIED", "FAILED", "PARTIALLY_VERIFIED")) + " from once group by 1",
    "latest_states": f"with {_LATEST} select tx_id, status, drift_count from lt",
    "tx_by_prefix": "select tx_id, status from transactions where starts_with(tx_id, '7c')",
    "tx_of_file": "select distinct tx_id from transactions where entity = 'keeper.rs' or ends_with(entity, '/keeper.rs')",
    "ledger_page": f"with {_ONCE} select id, committed_at from once order by committed_at desc nulls last, id limit 20 offset 40",
    "stale_pending": f"select tx_id, started_at from transactions where status = 'PENDING' and started_at < timestamp '{AS_OF}' - interval 7 day",
    "last_writer": f"""with t as (select lower(trim(tx_id)) as k, status, epoch_ms(loaded_at) as ph, loaded_at from transactions where loaded_at is not null and tx_id is not null), n as (select k, max((ph, 0, '', status, loaded_at)) m from t group by 1),
g as (select lower(trim(tx_id)) as k, max(({_CLOCK % 1}::bigint, {_CLOCK % 2}::int, {_CLOCK % 3})) dead from tx_tombstones where {_CLOCK % 1} is not null group by 1) select n.k as tx_id, m[4] as status from n left join g on n.k = g.k where dead is null or dead < (m[1], m[2], m[3])""",
    "extract_since": f"with {_ONCE}, b as (select * from once where signature is not null and upper(origin) in ('LOCAL', 'SIBLING') and (loaded_at is null or loaded_at > '2019-06-10') order by loaded_at nulls first, id limit 100) select 'entry' as kind, id::varchar as key from b union all select 'tombstone', concat_ws('@', tx_id, tombstone_hlc) from tx_tombstones",
    "clocks": f"select tx_id, {_CLOCK % 1}::bigint as physical, {_CLOCK % 2}::int as counter, {_CLOCK % 3} as node from tx_tombstones",
    "entry_hashes": f"with {_ONCE} select id, {_HASH} as hash from once",
    "open_entities": "select entity, count(*) as drift_count, min(started_at) as first_seen, max(started_at) as last_seen from transactions where entity is not null group by 1",
    "embedding_upsert": "select case when label = 2 then 'kept' when label = 7 then 'inserted' when label = 5 then 'updated' else 'unchanged' end as action, count(*) as n from embeddings group by 1",
    "last_events": "select user_id, arg_max(event_type, (event_type <> 'error', ts, event_id)) as event_type from events where user_id is not null and event_type is not null group by 1",
    "repo_posture": f"with {_LATEST} select source, count(*) filter (status = 'PENDING') as pending, sum(coalesce(drift_count, 0))::bigint as drift, max(detected_at) as last_detected from lt group by 1",
    "tx_stats": f"with {_ONCE}, e as (select tx_id, count(*) n, count(*) filter (verification_status = 'VERIFIED') v from once group by 1) select t.tx_id, coalesce(n, 0) as entries, coalesce(v, 0) as verified from (select distinct tx_id from transactions) t left join e on e.tx_id = t.tx_id",
    "risk_levels": f"with {_ONCE}, w as (select tx_id, 30 as weight from once where is_breaking union all select tx_id, case upper(risk) when 'HIGH' then 40 when 'MEDIUM' then 15 else 0 end from once where risk is not null union all select tx_id, 10 * {_EXT} from once where entity is not null), g as (select tx_id as key, round(sum(weight::double), 6) weight, count(*) reasons from w where tx_id is not null group by 1) select *, case when weight > 50 then 'high' when weight > 20 then 'medium' else 'low' end as level from g",
    "change_set_risk": "with g as (select session_id, count(distinct entity) files, coalesce(bool_or(starts_with(entity, 'src/ledger/')), false) as sensitive from transactions where session_id is not null group by 1) select *, case when sensitive or files >= 6 then 'high' when files >= 3 then 'medium' else 'low' end as level from g",
    "dead_code": "with c as (select p_partkey as symbol_id, round(greatest((p_size % 2 + p_size / 50 + p_size % 3 % 2) / 3 - case when p_size > 40 then 0.2 else 0 end - case when p_type = 'PROMO' then 0.5 else 0 end, 0), 6) as confidence from part) select * from c where confidence >= 0.75",
    "log_anomalies": "with l as (select doc_id, i as line_no, l[i] as line, array_to_string(l[greatest(i - 2, 1):least(i + 2, len(l))], chr(10)) as around from (select doc_id, string_split(text, chr(10)) l from documents where text is not null and source = 'ci_log'), unnest(generate_series(1, len(l))) u(i)) select substring(line, 1, 80) as label, count(*) as n, case when count(*) > 10 then 'critical' when count(*) > 3 then 'warning' else 'normal' end as severity, md5(arg_min(around, (doc_id, line_no))) as excerpt from l where regexp_matches(line, '(?i)error|failed|panic') group by 1",
    "job_elevation": "select job_name, case when bool_or(duration_ms > 10000000) then 'HIGH' when count(*) filter (duration_ms > 1000000 and duration_ms <= 10000000) > 3 then 'ELEVATED' else 'NORMAL' end as state from ci_outcome_history where duration_ms is not null group by 1",
    "module_groups": "with p as (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder, file_path as file from project_files where file_path is not null), n as (select folder, count(*) as files from p group by 1) select distinct folder, file, files from p join n using (folder)",
    "module_dependencies": "with f as (select id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) as folder from project_files) select a.folder as source, count(distinct b.folder) as targets from test_mapping join f a on a.id = test_file_id join f b on b.id = tested_file_id where a.folder <> b.folder group by 1",
    "service_diff": "with a as (select distinct service_name as name from project_files where service_name is not null), b as (select distinct regexp_extract(job_name, '^[a-z]+-([a-z]+)', 1) || '-svc' as name from ci_outcome_history where job_name is not null) select coalesce(a.name, b.name) as name, case when a.name is null then 'undeclared' when b.name is null then 'unused' else 'used' end as state from a full join (select * from b where name <> '-svc') b on a.name = b.name",
    "unknown_ci_files": "select ci_file_id, count(*) as n from ci_outcome_history c where not exists (select 1 from project_files f where f.id = c.ci_file_id) group by 1",
    "untested_files": "select id from project_files f where not exists (select 1 from test_mapping m where m.tested_file_id = f.id)",
    "test_predictions": "select distinct tested_file_id, test_file_id from test_mapping where tested_file_id in (select id from project_files where language = 'rust')",
    "files_by_mappings": "select id, (select count(*) from test_mapping m where m.tested_file_id = f.id) as n from project_files f order by n desc, id limit 10",
    "structural_coupling": with_sql("calls symbols", "select distinct a.file as from_file, b.file as to_file from calls left join symbols a on a.symbol_id = source join symbols b on b.symbol_id = target where b.kind = 'PROMO' and (a.file is null or a.file <> b.file)"),
    "hash_changes": "select file_path, content_hash from project_files a where not exists (select 1 from project_files b where b.parser_version = '2' and b.file_path = a.file_path and b.content_hash = a.content_hash)",
}
