"""Queries over the symbol graph and the ledger's hash chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.operators import graph as g
from loomgrain.sources import roles
from loomgrain.sources.roles import with_sql
from loomgrain.sources.tables import table


def _nodes(s, d):
    return roles.symbols(s, d).select(F.col("symbol_id").alias("node"), F.col("kind").alias("category"), (F.col("cognitive") / 50).alias("risk"))


def _having(s, d, condition):
    """The symbols with some property, as seeds."""
    return roles.symbols(s, d).filter(condition).select(F.col("symbol_id").alias("node"))


def _entries(s, d):
    return _having(s, d, "cognitive = 50")


def _few(s, d):
    return _having(s, d, "cognitive = 50 and kind = 'PROMO'")


def _calls(s, d):
    return roles.calls(s, d).filter("relation = 'calls'")


def _link(k):
    return F.sha2(k.cast("string"), 256)


def _chain(s, d):
    """The ledger as a hash chain with links broken on purpose: to an unknown entry, to none, to the last but one."""
    key = F.col("o_orderkey")
    prev = F.when((key % 1000 == 999) | (key == 0), F.lit(None)).when(key % 701 == 700, _link(key + 1_000_000_000)).when(key % 97 == 96, _link(key - 2)).otherwise(_link(key - 1))
    return table(s, d, "orders").select(_link(key).alias("hash"), prev.alias("prev"), key.alias("ord"))


def chain_walk(s, d):
    """A whole chain, and a fork that leads nowhere from the entry of each customer."""
    key = F.col("o_orderkey")
    chain = table(s, d, "orders").select(_link(key).alias("hash"), F.when(key > 0, _link(key - 1)).alias("prev"), key.alias("ord"))
    leaves = table(s, d, "customer").select(F.concat(F.lit("~"), F.col("c_custkey").cast("string")).alias("hash"), _link(F.col("c_custkey")).alias("prev"), F.col("c_custkey").alias("ord"))
    return g.walk_chain(chain.unionByName(leaves), "ord")


def subgraph(s, d):
    return g.induced(_calls(s, d), g.neighbourhood(_calls(s, d), _few(s, d), 3, 100))


def graph_delta(s, d):
    nodes, edges = _nodes(s, d), roles.calls(s, d)
    newer = nodes.filter("category <> 'PROMO'").withColumn("risk", F.when(F.col("risk") > 0.9, F.col("risk") + 1).otherwise(F.col("risk")))
    return g.graph_delta(nodes.filter("category <> 'SMALL'"), newer, edges.filter("relation <> 'tests'"), edges.filter("relation <> 'imports'"))


def file_services(s, d):
    """The deepest service root above each file; roots are folders that hold many files."""
    files = table(s, d, "project_files").select("id", "file_path")
    folders = files.select(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("root")).filter("root <> ''")
    top = files.select(F.regexp_extract("file_path", "^([^/]+)/", 1).alias("root")).filter("root <> ''")
    roots = folders.groupBy("root").agg(F.count("*").alias("n")).filter("n >= 20").select("root").unionByName(top).distinct()
    return g.longest_prefix(files, "file_path", roots, "root").select("id", "service")


def cross_service(s, d):
    owner = roles.symbols(s, d).select(F.col("symbol_id").alias("node"), F.col("language").alias("service"))
    return g.cross_service(roles.calls(s, d), owner)


def call_resolution(s, d):
    parts = table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"), "p_type")
    symbols = parts.filter("p_type <> 'SMALL'").select(F.col("p_partkey").alias("symbol_id"), "name")
    calls = table(s, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select("call_id", "name")
    return g.resolved_calls(calls, symbols)


def built_graph_counts(s, d):
    """Nodes by category and edges by relation of the graph built of files, test mappings and ledger entries."""
    files, maps = table(s, d, "project_files"), table(s, d, "test_mapping")
    urn = lambda kind, c: F.concat(F.lit(f"urn:repo:{kind}:"), c.cast("string"))
    file_nodes = files.filter("parse_status is null or parse_status <> 'DELETED'").select(urn("file", F.col("id")).alias("node"), F.lit("file").alias("category"), F.col("file_path").alias("label"))
    test_nodes = maps.select(urn("test", F.col("test_symbol_id")).alias("node"), F.lit("test").alias("category"), F.col("mapping_kind").alias("label"))
    covers = maps.filter("tested_file_id is not null").select(urn("test", F.col("test_symbol_id")).alias("source"), urn("file", F.col("tested_file_id")).alias("target"), F.lit("validates").alias("relation"))
    holds = maps.select(urn("file", F.col("test_file_id")).alias("source"), urn("test", F.col("test_symbol_id")).alias("target"), F.lit("defines").alias("relation"))
    nodes, edges = g.build_graph((file_nodes, covers), (test_nodes, holds))
    n = nodes.groupBy(F.lit("node").alias("part"), F.col("category").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("part"), F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


QUERIES = {
    "khop": lambda s, d: g.khop(_calls(s, d), _few(s, d), 3),
    "khop_last_relation": lambda s, d: g.khop(roles.calls(s, d), _few(s, d), 2, ["tests"]),
    "reachable": lambda s, d: g.reachable(_calls(s, d), _entries(s, d)),
    "blast_radius": lambda s, d: g.reachable(_calls(s, d), _entries(s, d), 5),
    "unreachable": lambda s, d: g.unreachable(_nodes(s, d), _calls(s, d), _entries(s, d)),
    "one_hop_used": lambda s, d: g.one_hop_used(_nodes(s, d), _calls(s, d)),
    "reach_counts": lambda s, d: g.reach_counts(_calls(s, d), _entries(s, d), 20),
    "pagerank": lambda s, d: g.pagerank(_calls(s, d), _nodes(s, d), 8).withColumn("rank", F.round("rank", 9)),
    "pagerank_settled": lambda s, d: g.pagerank(_calls(s, d), _nodes(s, d)).withColumn("rank", F.round("rank", 9)),
    "communities": lambda s, d: g.label_rounds(_calls(s, d), 5),
    "communities_settled": lambda s, d: g.communities(_calls(s, d)),
    "modularity": lambda s, d: g.modularity(_calls(s, d), _nodes(s, d).select("node", F.col("category").alias("community"))),
    "neighbourhood": lambda s, d: g.neighbourhood(_calls(s, d), _few(s, d), 2, 150),
    "neighbourhood_skipping": lambda s, d: g.neighbourhood(_calls(s, d), _few(s, d), 2, 150, _nodes(s, d), F.col("category") == "SMALL"),
    "induced_edges": lambda s, d: g.induced(roles.calls(s, d), _having(s, d, "kind = 'PROMO'")),
    "subgraph": subgraph,
    "top_risk_nodes": lambda s, d: _nodes(s, d).select("node", "risk").orderBy(F.desc("risk"), "node").limit(25),
    "spread_risk": lambda s, d: g.spread_risk(_nodes(s, d), _calls(s, d)).withColumn("risk", F.round("risk", 6)),
    "call_chains": lambda s, d: g.call_chains(_calls(s, d), _few(s, d), 3).select(F.array_join("path", ">").alias("path"), "length", "is_cycle"),
    "chain_coupling": lambda s, d: g.chain_coupling(g.call_chains(_calls(s, d), _few(s, d), 3), _having(s, d, "kind = 'PROMO'"), _having(s, d, "kind = 'SMALL'"), 0.5),
    "graph_delta": graph_delta,
    "file_services": file_services,
    "cross_service": cross_service,
    "call_resolution": call_resolution,
    "capped_edges": lambda s, d: g.capped_edges(_calls(s, d), "source", F.col("target") % 2, "target", 2),
    "built_graph": built_graph_counts,
    "chain_walk": chain_walk,
    "chain_faults": lambda s, d: g.chain_faults(_chain(s, d)),
    "graph_counts": lambda s, d: roles.calls(s, d).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets")),
}

_FEW = "risk = 1 and category = 'PROMO'"
_CALLS = "c as (select * from calls where relation = 'calls'), n as (select symbol_id as node, kind as category, cognitive / 50 as risk, language from symbols)"
_CHAIN = """ch as (select sha256(cast(o_orderkey as varchar)) as hash, o_orderkey as ord, case when o_orderkey % 1000 = 999 or o_orderkey = 0 then null when o_orderkey % 701 = 700 then sha256(cast(o_orderkey + 1000000000 as varchar))
  when o_orderkey % 97 = 96 then sha256(cast(o_orderkey - 2 as varchar)) else sha256(cast(o_orderkey - 1 as varchar)) end as prev from orders)"""


def _hops(source: str, seeds: str, k: int) -> str:
    parts = [f"l0 as (select distinct node from n where {seeds})"]
    parts += [f"l{i} as (select distinct e.target as node, e.relation from l{i - 1} join {source} e on e.source = l{i - 1}.node)" for i in range(1, k + 1)]
    return ", ".join(parts)


def _levels(edges: str, seeds: str, k: int) -> str:
    """Breadth-first levels up to depth k."""
    parts = [f"l0 as materialized (select distinct node, 0 as depth from n where {seeds})"]
    for i in range(1, k + 1):
        parts.append(f"l{i} as materialized (select * from l{i - 1} union all select node, {i} from (select distinct e.target as node from l{i - 1} join {edges} e on e.source = l{i - 1}.node where l{i - 1}.depth = {i - 1}) where node not in (select node from l{i - 1}))")
    return ", ".join(parts)


_RANKS = "links as (select distinct source, target from c), deg as (select source, count(*) degree from links group by 1), r0 as (select node, degree, 1.0 / (select count(*) from n) as rank from n left join deg on source = node)" + "".join(
    f", r{i} as materialized (select r.node, r.degree, 0.15 / (select count(*) from n) + 0.85 * (coalesce(given, 0) + (select coalesce(sum(rank), 0) from r{i - 1} where degree is null) / (select count(*) from n)) as rank from r{i - 1} r left join (select target, sum(rank / degree) given from links join r{i - 1} on node = source group by 1) x on x.target = r.node)"
    for i in range(1, 9)
)
_LABELS = "links as (select distinct source, target from (select source, target from c where source <> target union all select target, source from c where source <> target)), votes as (select * from links union all select distinct source, source from links), b0 as (select distinct source as node, source as community from links)" + "".join(
    f", b{i} as materialized (select source as node, arg_max(community, (n, -community)) as community from (select v.source, b.community, count(*) n from votes v join b{i - 1} b on b.node = v.target group by all) group by 1)" for i in range(1, 6)
)
_UND = "u as (select source, target from c union select target, source from c)"
_PATHS = """p1 as (select [node] as path, node as last, false as cyc, false as fin from n where risk = 1 and category = 'PROMO'), links as (select distinct source, target from c)""" + "".join(
    f", p{i + 1} as (select case when target is null then path else list_append(path, target) end as path, target as last, coalesce(list_contains(path, target), false) as cyc, target is null as fin from p{i} left join links on source = last where not cyc and not fin)" for i in range(1, 4)
) + ", chains as (select path, cyc from p2 where cyc or fin union all select path, cyc from p3 where cyc or fin union all select path, cyc from p4)"
_G = "calls symbols"
ORACLES = {
    "khop": with_sql(_G, f"+{_CALLS}, {_hops('c', _FEW, 3)} select *, 1 as hops from l1 union all select *, 2 from l2 union all select *, 3 from l3"),
    "khop_last_relation": with_sql(_G, f"+{_CALLS}, {_hops('calls', _FEW, 2)} select * from (select *, 1 as hops from l1 union all select *, 2 from l2) where relation = 'tests'"),
    "blast_radius": with_sql(_G, f"+{_CALLS}, {_levels('c', 'risk = 1', 5)} select * from l5"),
    "reachable": with_sql(_G, f"+{_CALLS}, {_levels('c', 'risk = 1', 30)} select * from l30"),
    "unreachable": with_sql(_G, f"+{_CALLS}, {_levels('c', 'risk = 1', 25)} select node from n where node not in (select node from l25)"),
    "one_hop_used": with_sql(_G, f"+{_CALLS} select distinct node from n where exists (select 1 from c where c.target = n.node and c.source <> n.node)"),
    "pagerank": with_sql(_G, f"+{_CALLS}, {_RANKS} select node, round(rank, 9) as rank from r8"),
    "communities": with_sql(_G, f"+{_CALLS}, {_LABELS} select * from b5"),
    "modularity": with_sql(
        _G,
        f"+{_CALLS}, b as (select distinct source, target from (select source, target from c where source <> target union all select target, source from c where source <> target)), per as (select x.category k, count(*) d, count(*) filter (x.category = y.category) i from b join n x on x.node = source join n y on y.node = target group by 1) select round(sum(i / m - (d / m) ** 2), 6) as modularity from per, (select sum(d)::double m from per)",
    ),
    "neighbourhood": with_sql(_G, f"+{_CALLS}, {_UND}, {_levels('u', _FEW, 2)} select * from l2 order by depth, node limit 150"),
    "neighbourhood_skipping": with_sql(_G, f"+{_CALLS}, {_UND}, v as (select * from u where target in (select node from n where category <> 'SMALL')), {_levels('v', _FEW, 2)} select * from l2 order by depth, node limit 150"),
    "induced_edges": with_sql(_G, f"+{_CALLS} select * from calls where source in (select node from n where category = 'PROMO') and target in (select node from n where category = 'PROMO')"),
    "subgraph": with_sql(_G, f"+{_CALLS}, {_UND}, {_levels('u', _FEW, 3)}, k as (select * from l3 order by depth, node limit 100) select c.* from c where source in (select node from k) and target in (select node from k)"),
    "top_risk_nodes": with_sql(_G, f"+{_CALLS} select node, risk from n order by risk desc, node limit 25"),
    "spread_risk": with_sql(_G, f"+{_CALLS} select n.node, round(greatest(n.risk, coalesce(max(s.risk) * 0.5, n.risk)), 6) as risk from n left join c on c.target = n.node left join n s on s.node = c.source group by n.node, n.risk"),
    "call_chains": with_sql(_G, f"+{_CALLS}, {_PATHS} select array_to_string(path, '>') as path, (len(path) - 1)::int as length, cyc as is_cycle from chains"),
    "chain_coupling": with_sql(
        _G,
        f"+{_CALLS}, {_PATHS}, q as (select path, list_distinct(path) d from chains), w as (select path, len(d) as nodes, (select count(*) from n where category = 'PROMO' and list_contains(d, node)) as changed, (select count(*) from n where category = 'SMALL' and list_contains(d, node)) as models from q) select path[1] as first, path[-1] as last, nodes, changed, case when nodes > 5 or changed >= 3 then 'high' else 'medium' end as level from w where models > 0 and changed / nodes >= 0.5",
    ),
    "graph_delta": with_sql(
        _G,
        f"""+{_CALLS}, a as (select * from n where category <> 'SMALL'), b as (select node, category, case when risk > 0.9 then risk + 1 else risk end risk from n where category <> 'PROMO'), x as (select * from calls where relation <> 'tests'), y as (select * from calls where relation <> 'imports')
select 'node_added' as kind, node::varchar as id from b where node not in (select node from a) union all select 'node_removed', node::varchar from a where node not in (select node from b)
union all select 'node_updated', a.node::varchar from a join b using (node) where (a.category, a.risk) is distinct from (b.category, b.risk)
union all select 'edge_added', source || '>' || target || '>' || relation from (select * from y except select * from x) union all select 'edge_removed', source || '>' || target || '>' || relation from (select * from x except select * from y)""",
    ),
    "file_services": "with f as (select id, file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) folder from project_files), r as (select folder as root from f where folder <> '' group by 1 having count(*) >= 20 union select distinct regexp_extract(file_path, '^([^/]+)/', 1) from f where contains(file_path, '/')) select id, arg_max(root, length(root)) as service from f left join r on file_path = root or starts_with(file_path, root || '/') group by id",
    "cross_service": with_sql(_G, "select a.language as from_service, b.language as to_service, count(*) as n from calls join symbols a on a.symbol_id = source join symbols b on b.symbol_id = target where a.language <> b.language group by all"),
    "call_resolution": "with p as (select p_partkey, p_brand || '/' || p_type || '/' || p_size as name, p_type from part), s as (select name, count(*) n, min(p_partkey) callee from p where p_type <> 'SMALL' group by 1) select l_orderkey as call_id, case when n = 1 then callee end as callee, case when n = 1 then 'RESOLVED' when n > 1 then 'AMBIGUOUS' else 'UNRESOLVED' end as state from lineitem join p on p_partkey = l_partkey left join s using (name)",
    "capped_edges": with_sql(_G, f"+{_CALLS} select *, case when row_number() over (partition by source order by target % 2 desc, target) > 2 then 'CAPPED' else 'KEPT' end as state from c"),
    "built_graph": """select 'node' as part, category as kind, count(*) as n from (select distinct 'file' as category, id from project_files where parse_status is null or parse_status <> 'DELETED' union select distinct 'test', test_symbol_id from test_mapping) group by all
union all select 'edge', relation, count(*) from (select distinct 'validates' as relation, test_symbol_id a, tested_file_id b from test_mapping where tested_file_id is not null union select distinct 'defines', test_file_id, test_symbol_id from test_mapping) group by all""",
    "chain_faults": f"""with {_CHAIN} select 'fork' as kind, prev as hash from ch where prev is not null group by prev having count(distinct hash) > 1 union all select 'orphan', hash from ch where prev is not null and prev not in (select hash from ch)
union all select 'extra_genesis', hash from ch where prev is null and ord > (select min(ord) from ch where prev is null)""",
    "chain_walk": "select sha256(cast(o_orderkey as varchar)) as hash, o_orderkey - (select min(o_orderkey) from orders) as place from orders union all select '~' || c_custkey, null from customer",
    "graph_counts": with_sql("calls", "select relation, count(*) as n, count(distinct source) as sources, count(distinct target) as targets from calls group by 1"),
    "reach_counts": with_sql(
        _G,
        f"+{_CALLS}, e0 as (select node as entry, node from n where risk = 1)"
        + "".join(f", e{i} as materialized (select * from e{i - 1} union select entry, target from e{i - 1} join c on source = node)" for i in range(1, 21))
        + " select node, count(*) as entrypoints from e20 where entry <> node group by 1",
    ),
}
