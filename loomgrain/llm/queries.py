"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm.confusables import normalize_text, spelled_files
from loomgrain.llm.encoding import encode
from loomgrain.llm.leakage import find_matches, remove_affected
from loomgrain.llm.selection import percentiles_by_day
from loomgrain.llm.splitting import split_oversized
from loomgrain.sources.tables import table


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return spelled_files(table(spark, where, "transactions"), table(spark, where, "project_files"))


def p1_normalized(spark: SparkSession, where: str) -> DataFrame:
    """Every distinct stored value of either field with the form that it shows."""
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("entity")) for f in ("entity", "entity_normalized")))
    values = table(spark, where, "transactions").select(F.inline(fields)).filter("entity is not null").distinct()
    return normalize_text(values, "entity", "visible_form")


def p6_ids(spark: SparkSession, where: str) -> DataFrame:
    return encode(table(spark, where, "documents"))


def p7_matches(spark: SparkSession, where: str) -> DataFrame:
    return find_matches(table(spark, where, "documents"), table(spark, where, "eval_items"))


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    return p7_matches(spark, where).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, where: str) -> DataFrame:
    documents = table(spark, where, "documents").select("doc_id", "source", "lang", "n_chars")
    return remove_affected(documents, p7_matches(spark, where))


def p8_pieces(spark: SparkSession, where: str) -> DataFrame:
    return split_oversized(table(spark, where, "documents"))


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    """Documents that were cut: their first pieces."""
    pieces = split_oversized(table(spark, where, "documents"))
    return pieces.filter("piece_no = 0").select("doc_id").distinct()


def p3_percentiles(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "ci_outcome_history").filter("id is not null")
    fields = F.struct("loaded_at", "job_name", "platform", F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "duration_ms")
    once = rows.select("id", fields.alias("r")).groupBy("id").agg(F.min("r").alias("r")).select("r.*")
    return percentiles_by_day(once, ["job_name", "platform"], "day", "duration_ms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_normalized, p3_percentiles, p6_ids, p7_found, p7_matches, p7_clean, p8_found, p8_pieces)}
ORACLES: dict[str, str] = {
    "p7_found": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') as words from documents where text is not null),
t as (select item_id, regexp_extract_all(lower(text), '[\pL\pN]+') as words from eval_items where text is not null),
grams as (select item_id, least(12, len(words)) as n, array_to_string(words[i:i + least(12, len(words)) - 1], ' ') as gram from (select *, unnest(range(1, len(words) - least(12, len(words)) + 2)) as i from t where len(words) > 0)),
sizes as (select distinct n from grams),
places as (select doc_id, n, array_to_string(words[i:i + n - 1], ' ') as gram from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from w, sizes where len(words) >= n))
select distinct doc_id, item_id from places join grams using (n, gram)
""",
    "p3_percentiles": """
with once as (select id, arg_min(struct_pack(j := job_name, f := platform, d := strftime(recorded_at, '%Y-%m-%d'), v := duration_ms), loaded_at) r from ci_outcome_history group by id),
r as (select r.j as job_name, r.f as platform, r.d as day, r.v as v from once where r.v is not null),
pcts as (select unnest([50, 90, 95, 99]) as p),
s as (select 'day' as scope, job_name, platform, day, v, row_number() over (partition by job_name, platform, day order by v) k, count(*) over (partition by job_name, platform, day) n from r
      union all
      select 'all', job_name, platform, null, v, row_number() over (partition by job_name, platform order by v), count(*) over (partition by job_name, platform) from r)
select scope, job_name, platform, day, cast(p as bigint) as p, v as value, n, cast(0 as bigint) as rank_error
from s, pcts where k = greatest(1, (n * p + 99) // 100)
""",
}
