"""Queries over the parts of the knowledge graph, on a small fixed set of facts that are written out here, with the rows that must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrain.operators import graph_load as g
from loomgrain.operators import nested
from loomgrain.sources import code
from loomgrain.sources.tables import table

_LOCK = """version = 3

[[package]]
name = "app"
version = "0.1.0"
dependencies = [
 "log",
 "rand 0.8.5",
 "gone",
]

[[package]]
name = "log"
version = "0.4.20"
source = "registry"

[[package]]
name = "rand"
version = "0.7.3"
source = "registry"

[[package]]
name = "rand"
version = "0.8.5"
source = "registry"
dependencies = [
 "log",
]
"""


def _services(s):
    return s.createDataFrame([("billing", "services/billing", ["ops"], ["jobs"], ["events"], ["pay"]), ("all", "services", None, None, None, None), (None, "x", ["nobody"], None, None, None)], "service string, root string, owners array<string>, queues array<string>, topics array<string>, rpcs array<string>")


def _routes(s):
    return s.createDataFrame([("GET", "/users", "show", "billing", ["token", None], ["shop", "urn:repo:service:web"], ["User"]), ("PUT", "/users", None, None, None, None, None), (None, "/x", "f", None, None, None, None)], "method string, path string, handler string, service string, auth array<string>, consumers array<string>, schemas array<string>")


def graph_parts(s, d):
    """The edges of all parts of the fixed facts."""
    services, routes = _services(s), _routes(s)
    decisions = s.createDataFrame([("t2", "use queues", "t1", ["src/a.rs", "Ledger", None]), ("t1", None, None, None)], "decision string, summary string, supersedes string, affected array<string>")
    models = s.createDataFrame([("User", "services/billing/user.rs"), ("Odd", "lib\\odd.rs"), ("Far", "services/far.rs")], "model string, file string")
    keys = s.createDataFrame([("DB_URL", "services/billing/env.rs")], "key string, file string")
    slos = s.createDataFrame([("Service", "billing", None, "ops", None, None), ("SLI", "errors", "billing", None, None, None), ("SLO", "uptime", "billing", "ops", "errors", ["page"]), ("Other", "x", None, None, None, None)], "kind string, name string, service string, owner string, indicator string, alert_policies array<string>")
    policies = s.createDataFrame([("p1", 'User::"ann"', "*", 'Path::"/users"'), ("p2", "*", 'Action::"read"', "billing")], "policy string, principal string, action string, resource string")
    locks = g.lock_packages(s.createDataFrame([(1, _LOCK), (2, None)], "id int, text string"), "id", "text")
    parts = [g.route_part(routes), g.decision_part(decisions), g.service_part(services), g.model_part(models, services), g.config_part(keys, services), g.objective_part(slos), g.policy_part(policies, routes.filter("method is not null"), services), g.package_part(locks, "id")]
    out = parts[0][1]
    for _, edges in parts[1:]:
        out = out.unionByName(edges)
    return out.distinct()


_EDGES = """
symbol:show handles endpoint:GET:/users; service:billing owns endpoint:GET:/users; endpoint:GET:/users authenticates security_boundary:token
service:shop consumes endpoint:GET:/users; service:web consumes endpoint:GET:/users; endpoint:GET:/users handles data_model:User
adr:t2 governs transaction:t2; adr:t1 governs transaction:t1; adr:t2 supersedes adr:t1; adr:t2 governs file:src/a.rs; adr:t2 governs symbol:Ledger
role:ops owns service:billing; service:billing depends_on observability_signal:jobs; service:billing depends_on observability_signal:events; service:billing calls endpoint:pay
data_model:User depends_on file:services/billing/user.rs; data_model:Odd depends_on file:lib/odd.rs; data_model:Far depends_on file:services/far.rs
service:billing owns data_model:User; service:all owns data_model:Far
config_key:DB_URL depends_on file:services/billing/env.rs; service:billing configures config_key:DB_URL
metric:errors monitors service:billing; slo:uptime monitors service:billing; role:ops owns slo:uptime; slo:uptime depends_on metric:errors; alert:page alerts_on slo:uptime
policy:p1 authorizes principal:User::"ann"; policy:p1 authorizes resource:Path::"/users"; policy:p2 authorizes action:Action::"read"; policy:p2 authorizes resource:billing
policy:p1 protected_by endpoint:GET:/users; policy:p1 protected_by endpoint:PUT:/users; policy:p2 protected_by service:billing
package:app@0.1.0 depends_on package:log@0.4.20; package:app@0.1.0 depends_on package:rand@0.8.5; package:app@0.1.0 depends_on package:gone@0.0.0; package:rand@0.8.5 depends_on package:log@0.4.20
"""


def usage_changes(s, d):
    before = s.createDataFrame([("a", "X"), ("a", "Y"), ("b", "Z"), ("c", "Q")], "file string, name string")
    after = s.createDataFrame([("a", "Y"), ("a", "W"), ("b", "Z"), ("e", "N")], "file string, name string")
    return g.usage_delta(before, after).select("file", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


def test_sources(s, d):
    pairs = lambda *rows: s.createDataFrame(list(rows), "test string, tested string")
    return g.test_mappings(pairs(("t1", "a"), ("t2", "b")), pairs(("t1", "a"), ("t3", "c"), ("t3", None)), pairs(("t2", "b"), ("t3", "d")))


def _code(s, d):
    return table(s, d, "documents").filter("source = 'code'").select("doc_id", "text", "file_path")


def changed_routes(s, d):
    """The routes that the packets' changed files have, by file."""
    found = nested.shred(table(s, d, "snapshots").filter("id is not null and packet_json is not null"), "id", "packet_json", owners=frozenset([nested.PACKET.tables["change"], nested.PACKET.tables["route"]]))
    changes = nested.flat_table(found, "change").select("__id", F.col("pos").alias("parent_pos"), F.col("path").alias("file")).filter("file is not null")
    routes = nested.flat_table(found, "route").select("__id", "parent_pos", F.concat_ws(" ", "method", F.coalesce("pathpattern", "path")).alias("route"))
    return g.changed_with(changes, routes.join(changes, ["__id", "parent_pos"]), F.col("route")).select("file", F.array_join("facts", ",").alias("routes"))


def changed_models(s, d):
    """The data models in the code of the files that packets change."""
    models = code.code_facts(_code(s, d), "doc_id", "text", "models", path="file_path").join(_code(s, d).select("doc_id", F.col("file_path").alias("file")), "doc_id")
    found = nested.shred(table(s, d, "snapshots").filter("id is not null and packet_json is not null"), "id", "packet_json", owners=frozenset([nested.PACKET.tables["change"]]))
    changed = nested.flat_table(found, "change").select(F.col("path").alias("file")).filter("file is not null")
    return g.changed_with(changed, models, F.col("name")).select("file", F.array_join("facts", ",").alias("models"))


def changed_gates(s, d):
    """The CI jobs whose own file a packet changes."""
    gates = table(s, d, "ci_outcome_history").select(F.col("ci_file_path").alias("file"), "job_name").filter("file is not null and job_name is not null")
    changed = table(s, d, "project_files").select(F.col("file_path").alias("file"))
    return g.changed_with(changed, gates, F.col("job_name")).select("file", F.array_join("facts", ",").alias("gates"))


def _facts(what):
    return lambda s, d: code.code_facts(_code(s, d), "doc_id", "text", what, path="file_path")


QUERIES = {"graph_parts": graph_parts, "usage_changes": usage_changes, "test_sources": test_sources, "changed_routes": changed_routes, "changed_models": changed_models, "changed_gates": changed_gates} | {f"code_{w}": _facts(w) for w in ("calls", "routes", "models", "logging", "entries")}


def _expected() -> str:
    rows = [e.split() for line in _EDGES.strip().splitlines() for e in line.split("; ")]
    return ", ".join(f"('urn:repo:{a}', 'urn:repo:{b}', '{r}')" for a, r, b in rows)


ORACLES = {
    "graph_parts": f"select * from (values {_expected()}) t(source, target, relation)",
    "usage_changes": "select * from (values ('a', 'W', 'X'), ('c', '', 'Q'), ('e', 'N', '')) t(file, added, removed)",
    "test_sources": "select * from (values ('t1', 'a', 'IMPORT', 1.0::double), ('t2', 'b', 'IMPORT', 1.0), ('t3', 'c', 'NAMING_CONVENTION', 0.5), ('t3', 'd', 'COVERAGE', 0.9)) t(test, tested, kind, confidence)",
    "changed_gates": "select file_path as file, coalesce((select string_agg(job_name, ',' order by job_name) from (select distinct job_name from ci_outcome_history c where c.ci_file_path = f.file_path)), '') as gates from project_files f",
}
