"""Typed parts of the knowledge graph from tables of facts: (nodes, edges) each, for graph.build_graph().

nodes: node, category, label. edges: source, target, relation. Ids are urn:NAMESPACE:KIND:name with slashes one way. Each part is
projections, explodes of short lists and equality joins; nothing is collected. Rows whose own name is null
give nothing; a null in a list gives no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.text import urn

#: The namespace of the ids.
NAMESPACE = "repo"
Part = tuple[DataFrame, DataFrame]


def _id(kind: str, name: Column) -> Column:
    return F.when(name.startswith("urn:"), name).otherwise(urn(NAMESPACE, kind, name))


def _nodes(rows: DataFrame, node: Column, category: str, label: Column) -> DataFrame:
    return rows.select(node.alias("node"), F.lit(category).alias("category"), label.alias("label")).filter("node is not null")


def _edges(rows: DataFrame, source: Column, relation: str, target: Column) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation")).filter("source is not null and target is not null")


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _each(rows: DataFrame, *keep: str, of: str) -> DataFrame:
    return rows.select(*keep, F.explode(of).alias("one")).filter("one is not null")


def service_of(rows: DataFrame, path: str, services: DataFrame) -> DataFrame:
    """rows with the service whose root is the longest that their path lies under; rows of none are left out.

    services: service, root. A path is joined with the roots that equal one of its own leading folders, so no pair is tried in vain.
    """
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    roots = services.select("service", F.regexp_replace(F.replace(F.col("root"), F.lit("\\"), F.lit("/")), "/+$", "").alias("__root"))
    keys = rows.columns
    placed = rows.select("*", F.explode(folders).alias("__folder")).join(roots, F.col("__folder") == F.col("__root"))
    return placed.groupBy(*keys).agg(F.max(F.struct(F.length("__root").alias("n"), "service")).alias("__s")).select(*keys, F.col("__s.service").alias("service"))


def route_part(routes: DataFrame) -> Part:
    """Endpoints of routes (method, path, handler, service, auth, consumers, schemas).

    A handler handles, a service owns and consumers consume an endpoint; an endpoint authenticates by its
    requirements and handles its schemas.
    """
    r = routes.withColumn("e", _id("endpoint", F.concat_ws(":", "method", "path"))).filter("method is not null and path is not null")
    nodes = _nodes(r, F.col("e"), "endpoint", F.concat_ws(" ", "method", "path"))
    edges = _union(
        _edges(r, _id("symbol", F.col("handler")), "handles", F.col("e")),
        _edges(r, _id("service", F.col("service")), "owns", F.col("e")),
        _edges(_each(r, "e", of="auth"), F.col("e"), "authenticates", _id("security_boundary", F.col("one"))),
        _edges(_each(r, "e", of="consumers"), _id("service", F.col("one")), "consumes", F.col("e")),
        _edges(_each(r, "e", of="schemas"), F.col("e"), "handles", _id("data_model", F.col("one"))),
    )
    return nodes, edges


def decision_part(decisions: DataFrame) -> Part:
    """Decisions (decision, summary, supersedes, affected): each governs its transaction and what it affects, and supersedes an older one.

    An affected name with a slash, or of a source file, is a file, any other a symbol.
    """
    d = decisions.filter("decision is not null").withColumn("e", _id("adr", F.col("decision")))
    one = F.col("one")
    affected = F.when(one.contains("/") | one.endswith(".rs") | one.endswith(".ts"), _id("file", one)).otherwise(_id("symbol", one))
    edges = _union(
        _edges(d, F.col("e"), "governs", _id("transaction", F.col("decision"))),
        _edges(d, F.col("e"), "supersedes", _id("adr", F.col("supersedes"))),
        _edges(_each(d, "e", of="affected"), F.col("e"), "governs", affected),
    )
    return _nodes(d, F.col("e"), "adr", F.concat(F.lit("ADR: "), F.coalesce("summary", F.lit("")))), edges


def service_part(services: DataFrame) -> Part:
    """Declared services (service, owners, queues, topics, rpcs): owned by roles, depending on queues and topics, calling endpoints."""
    s = services.filter("service is not null").withColumn("e", _id("service", F.col("service")))
    parts = [("owners", "role", "role", "Owner: "), ("queues", "observability_signal", "observability_signal", "Queue: "), ("topics", "observability_signal", "observability_signal", "Topic: "), ("rpcs", "endpoint", "endpoint", "RPC: ")]
    nodes, edges = [_nodes(s, F.col("e"), "service", F.col("service"))], []
    for column, kind, category, label in parts:
        each = _each(s, "e", of=column)
        other = _id(kind, F.col("one"))
        nodes.append(_nodes(each, other, category, F.concat(F.lit(label), "one")))
        edges.append(_edges(each, other, "owns", F.col("e")) if column == "owners" else _edges(each, F.col("e"), "calls" if column == "rpcs" else "depends_on", other))
    return _union(*nodes), _union(*edges)


def _file_bound(rows: DataFrame, name: str, kind: str, label: str, services: DataFrame, relation: str) -> Part:
    m = rows.filter(F.col(name).isNotNull()).withColumn("e", _id(kind, F.col(name)))
    owned = service_of(m.select("e", "file").filter("file is not null").distinct(), "file", services)
    edges = _union(_edges(m, F.col("e"), "depends_on", _id("file", F.col("file"))), _edges(owned, _id("service", F.col("service")), relation, F.col("e")))
    return _nodes(m, F.col("e"), kind, F.concat(F.lit(label), name)), edges


def model_part(models: DataFrame, services: DataFrame) -> Part:
    """Data models (model, file): they depend on their file and are owned by the service under whose root it lies."""
    return _file_bound(models, "model", "data_model", "Model: ", services, "owns")


def config_part(keys: DataFrame, services: DataFrame) -> Part:
    """Configuration keys (key, file): they depend on their file; the service of that file configures them."""
    return _file_bound(keys, "key", "config_key", "Config: ", services, "configures")


def objective_part(objectives: DataFrame) -> Part:
    """OpenSLO entities (kind, name, service, owner, indicator, alert_policies).

    Owners own; objectives and indicators monitor their service; an objective depends on its indicator; alert policies alert on it.
    """
    kinds = {"Service": "service", "SLI": "metric", "SLO": "slo", "AlertPolicy": "alert", "AlertCondition": "alert", "AlertNotificationTarget": "role", "DataSource": "observability_signal"}
    kind = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in kinds.items()))
    o = objectives.filter("name is not null").withColumn("category", kind).filter("category is not null").withColumn("e", F.concat(F.lit(f"urn:{NAMESPACE}:"), "category", F.lit(":"), "name"))
    edges = _union(
        _edges(o, _id("role", F.col("owner")), "owns", F.col("e")),
        _edges(o.filter("category in ('metric', 'slo')"), F.col("e"), "monitors", _id("service", F.col("service"))),
        _edges(o.filter("category = 'slo'"), F.col("e"), "depends_on", _id("metric", F.col("indicator"))),
        _edges(_each(o.filter("category = 'slo'"), "e", of="alert_policies"), _id("alert", F.col("one")), "alerts_on", F.col("e")),
    )
    return o.select(F.col("e").alias("node"), "category", F.concat_ws(": ", "kind", "name").alias("label")), edges


def policy_part(policies: DataFrame, endpoints: DataFrame | None = None, services: DataFrame | None = None) -> Part:
    """Policies (policy, principal, action, resource): each authorizes its three parts; * stands for none.

    What a resource names, an endpoint by its path or a service by its name, is protected by the policy.
    """
    p = policies.filter("policy is not null").withColumn("e", _id("policy", F.col("policy")))
    nodes, edges = [_nodes(p, F.col("e"), "policy", F.concat(F.lit("Policy: "), "policy"))], []
    for part in ("principal", "action", "resource"):
        named = p.filter((F.col(part) != "*") & F.col(part).isNotNull())
        nodes.append(_nodes(named, _id(part, F.col(part)), part, F.concat(F.lit(f"{part.capitalize()}: "), part)))
        edges.append(_edges(named, F.col("e"), "authorizes", _id(part, F.col(part))))
    name = F.regexp_extract("resource", r'"([^"]*)"$', 1)
    bare = p.select("e", F.when(name != "", name).otherwise(F.col("resource")).alias("named"))
    if endpoints is not None:
        hit = bare.join(endpoints.select(F.col("path").alias("named"), _id("endpoint", F.concat_ws(":", "method", "path")).alias("to")).distinct(), "named")
        edges.append(_edges(hit, F.col("e"), "protected_by", F.col("to")))
    if services is not None:
        hit = bare.join(services.select(F.col("service").alias("named"), _id("service", F.col("service")).alias("to")).distinct(), "named")
        edges.append(_edges(hit, F.col("e"), "protected_by", F.col("to")))
    return _union(*nodes), _union(*edges)


def lock_packages(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, name, version, source, dependencies of the packages of Cargo lock files, by column expressions."""
    blocks = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n?\[\[package\]\]\n")
    rows = texts.select(key, F.posexplode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("place", "b"))
    field = lambda n: F.nullif(F.regexp_extract("b", rf'(?m)^{n} = "([^"]*)"', 1), F.lit(""))
    needed = F.regexp_extract_all(F.regexp_extract("b", r"(?s)^dependencies = \[(.*?)\]|\ndependencies = \[(.*?)\]", 2), F.lit(r'"([^"]+)"'), F.lit(1))
    return rows.select(key, "place", field("name").alias("name"), field("version").alias("version"), field("source").alias("source"), needed.alias("dependencies")).filter("name is not null")


def package_part(packages: DataFrame, key: str) -> Part:
    """Packages and what they depend on, within each lock file.

    A dependency is a name, or a name and a version, or also a source. Of several packages of the name those of the
    version count, then those of the same source as the dependent one, then the first in the file; a name that isn't there stands for
    version 0.0.0.
    """
    ident = lambda name, version: urn(NAMESPACE, "package", F.concat(name, F.lit("@"), F.coalesce(version, F.lit("0.0.0"))))
    nodes = _nodes(packages, ident(F.col("name"), F.col("version")), "package", F.concat_ws(" ", "name", "version"))
    wanted = packages.select(key, F.col("name").alias("by"), F.col("version").alias("by_version"), F.col("source").alias("by_source"), F.explode("dependencies").alias("d"))
    words = F.split("d", " ")
    wanted = wanted.select("*", F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).alias("wish"))
    same = F.coalesce(F.col("by_source").eqNullSafe(F.col("source")) | F.col("by_source").isNull(), F.lit(False))
    fits = F.struct((F.col("wish").isNull() | (F.col("wish") == F.col("version"))).cast("int").alias("v"), same.cast("int").alias("s"), (-F.col("place")).alias("first"))
    found = wanted.join(packages.select(key, "place", "name", "version", "source"), [key, "name"], "left")
    best = found.groupBy(key, "by", "by_version", "d", "name", "wish").agg(F.max_by("version", fits).alias("version"))
    return nodes, _edges(best, ident(F.col("by"), F.col("by_version")), "depends_on", ident(F.col("name"), F.coalesce("version", "wish")))


def changed_with(changed: DataFrame, facts: DataFrame, what: Column) -> DataFrame:
    """file, facts: the sorted distinct facts (routes, data models, CI gates) of each changed file; files without any have an empty list.

    changed and facts have file; a file's own facts are as few as a file can hold.
    """
    per_file = facts.groupBy("file").agg(F.array_sort(F.collect_set(what)).alias("facts"))
    return changed.select("file").distinct().join(per_file, "file", "left").select("file", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def usage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, added, removed: which names (environment variables, configuration keys) a file reads anew or no more; unchanged files have no row.

    before and after: file, name.
    """
    a, b = before.select("file", "name").distinct().withColumn("was", F.lit(True)), after.select("file", "name").distinct().withColumn("is", F.lit(True))
    both = a.join(b, ["file", "name"], "full").filter("was is null or is is null")
    side = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("name"))))
    return both.groupBy("file").agg(side("was").alias("added"), side("is").alias("removed"))


def test_mappings(imports: DataFrame, names: DataFrame, coverage: DataFrame) -> DataFrame:
    """test, tested, kind, confidence: by import 1.0, by coverage 0.9, by name 0.5; of several the surest counts."""
    each = [df.select("test", "tested", F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")) for df, kind, sure in ((imports, "IMPORT", 1.0), (coverage, "COVERAGE", 0.9), (names, "NAMING_CONVENTION", 0.5))]
    return _union(*each).filter("test is not null and tested is not null").groupBy("test", "tested").agg(F.max_by("kind", "confidence").alias("kind"), F.max("confidence").alias("confidence"))
