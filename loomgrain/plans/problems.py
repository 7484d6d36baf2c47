"""Queries of the general data problems: orphan references, interval gaps, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators import intervals as iv
from loomgrain.operators import nested, references
from loomgrain.sources.tables import micros, table

#: Gaps that p4_found reports: up to 3 days.
MAX_GAP_US = 259_200_000_000


def _references(spark: SparkSession, where: str) -> list[DataFrame]:
    return [table(spark, where, n) for n in ("ledger_entries", "transactions", "tx_tombstones", "test_mapping", "project_files")]


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    return references.all_orphans(*_references(spark, where))


def p2_report(spark: SparkSession, where: str) -> DataFrame:
    return references.orphan_report(*_references(spark, where))


def _spans(spark: SparkSession, where: str) -> DataFrame:
    return iv.intervals(table(spark, where, "transactions"), "entity", micros("started_at"), micros("resolved_at"))


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    length = F.col("gap_end_us") - F.col("gap_start_us")
    return iv.gaps(_spans(spark, where)).filter((length >= 1) & (length <= MAX_GAP_US))


def p4_gaps(spark: SparkSession, where: str) -> DataFrame:
    return iv.gaps(_spans(spark, where))


def p4_periods(spark: SparkSession, where: str) -> DataFrame:
    return iv.periods(_spans(spark, where))


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return nested.packet_records(table(spark, where, "snapshots"))


def _packets(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "snapshots").filter("id is not null and packet_json is not null")


def _flat(name: str):
    def query(spark: SparkSession, where: str) -> DataFrame:
        found = nested.shred(_packets(spark, where), "id", "packet_json", owners=frozenset([nested.PACKET.tables[name]]))
        return nested.flat_table(found, name).withColumnRenamed("__id", "snapshot_id")

    return query


def p5_lists(spark: SparkSession, where: str) -> DataFrame:
    """The items of all further lists of changes, symbols and decisions, such as imports and environment variables."""
    return nested.list_items(nested.shred(_packets(spark, where), "id", "packet_json")).withColumnRenamed("__id", "snapshot_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_gaps, p4_periods, p5_found, p5_lists)} | {f"p5_{n}s": _flat(n) for n in nested.PACKET.tables}

_P2 = r"""
led as (select id, arg_min(struct_pack(k := key, p := period), loaded_at) r, min(loaded_at) loaded from (
          select id, loaded_at, lower(regexp_replace(tx_id, '^\s+|\s+$', '', 'g')) as key, strftime(committed_at, '%Y-%m-%d') as period from ledger_entries) group by id),
tx as (select lower(regexp_replace(tx_id, '^\s+|\s+$', '', 'g')) as key, min(loaded_at) born from transactions where tx_id is not null group by 1),
dead as (select lower(regexp_replace(tx_id, '^\s+|\s+$', '', 'g')) as key, min(epoch_ms(cast(regexp_extract(trim(tombstone_hlc), '^(\d{1,18})-', 1) as bigint))) died from tx_tombstones group by 1),
map as (select id, arg_min(struct_pack(k := tested_file_id, p := strftime(last_indexed_at, '%Y-%m-%d')), loaded_at) r, min(loaded_at) loaded from test_mapping group by id),
found as (
  select 'ledger_entries' as child_table, led.r.p as period, led.id as child_id
  from led left join tx on led.r.k = tx.key left join dead on led.r.k = dead.key
  where led.r.k is not null and (tx.key is null or born > loaded or died <= loaded)
  union all
  select 'test_mapping', map.r.p, map.id from map left join project_files f on map.r.k = f.id
  where map.r.k is not null and (f.id is null or f.loaded_at > loaded or f.deleted_at <= loaded))
"""
_P4 = """
spans as (select distinct entity, epoch_us(started_at) s, epoch_us(resolved_at) e from transactions where entity is not null and resolved_at > started_at),
reach as (select *, max(e) over (partition by entity order by s, e rows between unbounded preceding and 1 preceding) before from spans),
numbered as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by entity order by s, e rows unbounded preceding) k from reach),
periods as (select entity, k, min(s) period_start_us, max(e) period_end_us from numbered group by entity, k),
gaps as (select entity, period_end_us gap_start_us, lead(period_start_us) over (partition by entity order by k) gap_end_us from periods)
"""
# Packets out of their wrappers: JSON text in strings, then the first object of a list, then an object under packet or payload,
# four times over, which is deeper than any wrapper at hand; every step leaves a packet as it is.
_ROOT_STEPS = 4
_P5 = r"""
j0 as (select distinct id, trim(packet_json, chr(65279) || chr(32) || chr(10) || chr(13) || chr(9)) as t from snapshots where id is not null and packet_json is not null),
r0 as (select id, t::json as j from j0 where json_valid(t)),
""" + "".join(f"""
s{k} as (select id, case when json_type(j) = 'VARCHAR' then case when json_valid(trim(j->>'$', chr(65279) || ' ')) then trim(j->>'$', chr(65279) || ' ')::json end
                 when json_type(j) = 'ARRAY' then list_filter(from_json(j, '["json"]'), lambda x: json_type(x) in ('OBJECT', 'VARCHAR'))[1] else j end as j from r{k - 1}),
r{k} as (select id, case when json_type(j) = 'OBJECT' and coalesce(json_type(j->'changes'), 'NULL') = 'NULL' and coalesce(json_type(coalesce(j->'relevantDecisions', j->'relevant_decisions')), 'NULL') = 'NULL' and coalesce(j->'packet', j->'payload') is not null
                 then coalesce(j->'packet', j->'payload') else j end as j from s{k} where j is not null),""" for k in range(1, _ROOT_STEPS + 1)) + f"""
root as (select distinct id, j::varchar as t from r{_ROOT_STEPS} where json_type(j) = 'OBJECT'),
lists as (select id, t::json->'changes' as c, coalesce(t::json->'relevantDecisions', t::json->'relevant_decisions') as d from root),
as_list as (select id, case json_type(c) when 'ARRAY' then from_json(c, '["json"]') when 'OBJECT' then [c] end as c, case json_type(d) when 'ARRAY' then from_json(d, '["json"]') when 'OBJECT' then [d] end as d from lists),
changes as (select id, unnest(range(len(c))) as pos, unnest(c) as x from as_list),
symbols as (select id, pos as parent_pos, case json_type(x->'symbols') when 'ARRAY' then from_json(x->'symbols', '["json"]') when 'OBJECT' then [x->'symbols'] end as l from changes where json_type(x) = 'OBJECT'),
symbol as (select id, parent_pos, unnest(range(len(l))) as pos, unnest(l) as x from symbols),
decision as (select id, unnest(range(len(d))) as pos, unnest(d) as x from as_list),
tiers as (select id, pos, coalesce(nullif(x->>'stalenessTier', 'null'), x->>'staleness_tier') as tier from decision where json_type(x) = 'OBJECT')
"""
ORACLES = {
    "p5_found": f"""with {_P5}
select id as snapshot_id, 'change' as record_kind, -1::bigint as parent_pos, pos, x->>'path' as item_key from changes where json_type(x) <> 'NULL'
union select id, 'symbol', parent_pos, pos, x->>'name' from symbol where json_type(x) <> 'NULL'
union select id, 'decision', -1, pos, lower(tier) from tiers where tier is not null""",
    "p2_found": f"with {_P2} select distinct * from found",
    "p2_report": f"with {_P2} select child_table, period, count(*) as n_orphans from found group by all",
    "p4_found": f"with {_P4} select * from gaps where gap_end_us - gap_start_us between 1 and {MAX_GAP_US}",
    "p4_gaps": f"with {_P4} select * from gaps where gap_end_us is not null",
    "p4_periods": f"with {_P4} select entity, period_start_us, period_end_us from periods",
}
