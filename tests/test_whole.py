"""Nothing is left out: each test holds what an earlier form of an operator dropped."""

import json
import random
from collections import Counter, defaultdict

import pytest

from loomgrain.operators import graph, nested
from loomgrain.plans import registry

ROUTED = {
    "schemaVersion": "v1",
    "changes": [
        "odd",
        {
            "path": "a",
            "analysisStatus": {"symbols": "ok", "imports": "notRun"},
            "imports": {"importedFrom": ["x", None, "y"], "exportedSymbols": []},
            "apiRoutes": [None, {"method": "GET", "path": "/v1", "symbols": [{"name": "r"}]}, {"method": "PUT"}],
            "symbols": [{"name": "s", "lineStart": 3, "cognitiveComplexity": 7, "entrypointKind": "MAIN", "metadata": {"derive": "D", "odd[]": "1", "tags": [[1, {"k": True}]]}}],
            "dataModels": {"lone": 1.50},
        },
    ],
    "relevantDecisions": [{"heading": "h", "excerpt": "e", "rerank_score": 0.5, "later": {"field": "f"}}],
    "other": {"changes": [{"path": "decoy"}]},
}


def test_flat_tables_hold_every_field(spark):
    rows = [(1, json.dumps(ROUTED)), (2, json.dumps({"payload": [ROUTED]})), (1, json.dumps(ROUTED))]
    found = nested.shred(spark.createDataFrame(rows, "id bigint, packet_json string"), "id", "packet_json").cache()
    of = lambda name: {(r["__id"], r.parent_pos, r.pos): r for r in nested.flat_table(found, name).collect()}
    changes, symbols, decisions, routes = of("change"), of("symbol"), of("decision"), of("route")
    for i in (1, 2):
        assert changes[i, -1, 0].path is None and changes[i, -1, 0].more == {"": "odd"}
        c = changes[i, -1, 1]
        assert (c.path, c.analysisstatus_symbols, c.analysisstatus_imports, c.more) == ("a", "ok", "notRun", {"datamodels.lone": "1.5"})
        s = symbols[i, 1, 0]
        assert (s.name, s.linestart, s.cognitivecomplexity, s.entrypointkind, s.more) == ("s", "3", "7", "MAIN", {"metadata.derive": "D", "metadata.odd[\\]": "1"})
        d = decisions[i, -1, 0]
        assert (d.heading, d.excerpt, d.rerankscore, d.more) == ("h", "e", "0.5", {"later.field": "f"})
        assert {k[1:]: (r.method, r.path) for k, r in routes.items() if k[0] == i} == {(1, 1): ("GET", "/v1"), (1, 2): ("PUT", None)}
    assert (len(changes), len(symbols), len(decisions), len(routes)) == (4, 2, 2, 4)
    lists = {(r.list_path, *r.ancestors, r.pos): (r.kind, r.value, r.fields) for r in nested.list_items(found).collect() if r["__id"] == 2}
    assert lists == {
        ("changes[].imports.importedfrom[]", 1, 0): ("string", "x", {}),
        ("changes[].imports.importedfrom[]", 1, 1): ("null", None, {}),
        ("changes[].imports.importedfrom[]", 1, 2): ("string", "y", {}),
        ("changes[].apiroutes[].symbols[]", 1, 1, 0): ("object", None, {"name": "r"}),
        ("changes[].symbols[].metadata.tags[]", 1, 0, 0): ("list", None, {}),
        ("changes[].symbols[].metadata.tags[][]", 1, 0, 0, 0): ("number", "1", {}),
        ("changes[].symbols[].metadata.tags[][]", 1, 0, 0, 1): ("object", None, {"k": "true"}),
    }


@pytest.mark.parametrize("depth", [1, 31, 32, 33, 500, 5000])
def test_values_at_any_depth_have_their_path(depth):
    below = "changes[].x" + ".d" * depth
    text = "{" + '"changes":[{"x":' + '{"d":' * depth + json.dumps({"n": -1.50, "l": [1, {"b": True}, {}], "k\n": "s"}) + "}" * depth + "}]}"
    got = {(t.path, t.value, t.ordinals, t.kind) for t in nested.record_triples(text, nested.PACKET)}
    assert got == {
        ("changes[]", None, (0,), "object"),
        (below + ".n", "-1.5", (0,), "number"),
        (below + ".l[]", "1", (0, 0), "number"),
        (below + ".l[]", None, (0, 1), "object"),
        (below + ".l[].b", "true", (0, 1), "boolean"),
        (below + ".l[]", None, (0, 2), "object"),
        (below + ".k\n", "s", (0,), "string"),
    }


SMALL = {"changes": [{"path": "b"}]}


def wrap_in(kind, times):
    text = json.dumps(SMALL)
    for _ in range(times):
        text = {"object": '{"any": %s}', "list": "[null, 1, %s]"}[kind] % text if kind != "string" else json.dumps({"Any": text}) if len(text) < 500 else '{"x": %s}' % text
    return text


@pytest.mark.parametrize(
    "text",
    [
        wrap_in("object", 64),
        wrap_in("object", 3000),
        wrap_in("list", 3000),
        wrap_in("string", 100),
        json.dumps({"schemaVersion": "2", "payload": SMALL}),
        json.dumps({"schema_version": 2, "packet": {"schemaVersion": "1", **SMALL}}),
        json.dumps({**SMALL, "data": {"k": 1}}),
        json.dumps({**SMALL, "value": "{not json", "body": "[1]", "payload": {"changes": [{"path": "decoy"}, {"path": "decoy"}]}}),
        json.dumps({"whatever": json.dumps(SMALL)}),
        json.dumps({"whatever": [SMALL]}),
        json.dumps([None, {"meta": 1}, json.dumps([SMALL])]),
        json.dumps({"changes": [], "inner": {"changes": ["x"], "inner": SMALL}}),
        "\ufeff " + json.dumps("\ufeff" + json.dumps(SMALL)),
    ],
)
def test_a_packet_is_found_in_any_wrapping(text):
    got = [t for t in nested.record_triples(text, nested.PACKET)]
    assert [(t.path, t.value, t.ordinals) for t in got] == [("changes[]", None, (0,)), ("changes[].path", "b", (0,))]
    only = frozenset(["changes[]", "changes[].path"])
    assert nested.record_triples(text, nested.PACKET, only=only) == got


def test_lists_elsewhere_in_a_packet_do_not_count():
    text = json.dumps({"schemaVersion": "v1", "headHash": "h", "branchName": "b", "riskLevel": "low", "knowledgeGraph": {"changes": [{"path": "decoy"}]}})
    assert nested.record_triples(text, nested.PACKET) == []
    assert nested.record_triples(json.dumps({"changes": ["x", None]}), nested.PACKET)[0].value == "x"


def test_lone_surrogates_are_replaced():
    got = nested.record_triples('{"changes":[{"path":"a\\ud800b","\\udfff":"x"}]}', nested.PACKET)
    assert [(t.path, t.value) for t in got] == [("changes[]", None), ("changes[].path", "a\ufffdb"), ("changes[].\ufffd", "x")]


def brute_labels(edges):
    """Labels at rest, or of a swap for ever the last two rounds, and the number of rounds that moved anything."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    before, labels, rounds = None, {v: v for v in near}, 0
    while True:
        fresh = {v: min(Counter([labels[v], *(labels[u] for u in near[v])]).items(), key=lambda x: (-x[1], x[0]))[0] for v in near}
        if fresh in (labels, before):
            return labels, fresh, rounds
        before, labels, rounds = labels, fresh, rounds + 1


def graph_where(fits):
    for seed in range(100_000):
        rng = random.Random(seed)
        n = rng.randrange(6, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n, 3 * n))]
        if fits(*brute_labels(edges)):
            return edges
    raise AssertionError("no such graph")


@pytest.mark.parametrize("kind", ["late rest", "swap"])
def test_communities_come_to_rest(spark, kind):
    edges = graph_where((lambda a, b, n: a != b) if kind == "swap" else (lambda a, b, n: a == b and n > 10))
    a, b, _ = brute_labels(edges)
    df = spark.createDataFrame(edges, "source bigint, target bigint")
    out = {r.node: (r.community, r.settled) for r in graph.communities(df).collect()}
    assert out == {v: (min(a[v], b[v]), a[v] == b[v]) for v in a}
    if kind == "late rest":
        with pytest.raises(RuntimeError):
            graph.communities(df, 3)


def test_pagerank_comes_to_rest(spark):
    n = 9
    edges = [(i, i + 1) for i in range(n - 2)] + [(n - 2, 0), (3, n - 1)]  # a long ring and a dead end
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    ranks = [1 / n] * n
    for _ in range(3000):
        lost = sum(ranks[v] for v in range(n) if v not in out)
        ranks = [0.15 / n + 0.85 * (lost / n + sum(ranks[u] / len(out[u]) for u in out if v in out[u])) for v in range(n)]
    links, nodes = spark.createDataFrame(edges, "source bigint, target bigint"), spark.range(n).withColumnRenamed("id", "node")
    got = {r.node: r["rank"] for r in graph.pagerank(links, nodes).collect()}
    assert all(abs(got[v] - ranks[v]) < 1e-10 for v in range(n)) and abs(sum(got.values()) - 1) < 1e-9
    with pytest.raises(RuntimeError):
        graph.pagerank(links, nodes, most=20)


def test_both_fields_get_their_visible_form(spark, tmp_path):
    queries = pytest.importorskip("loomgrain.llm.queries")
    rows = [("a", "\u0430"), ("a", "b"), (None, "b"), ("\uff41", None)]
    spark.createDataFrame(rows, "entity string, entity_normalized string").write.parquet(str(tmp_path / "transactions.parquet"))
    found = queries.p1_normalized(spark, str(tmp_path)).collect()
    assert sorted((r.field_name, r.entity) for r in found) == [("entity", "a"), ("entity", "\uff41"), ("entity_normalized", "b"), ("entity_normalized", "\u0430")]
    assert len({r.visible_form for r in found if r.entity != "b"}) == 1


def test_predictions_and_words_of_whole_tables(spark, tmp_path):
    tables = {
        "test_mapping": spark.createDataFrame([(1, 9), (1, 9), (2, 9), (3, 9), (None, 9)], "tested_file_id bigint, test_file_id bigint"),
        "project_files": spark.createDataFrame([(1, "rust"), (2, None)], "id bigint, language string"),
        "documents": spark.createDataFrame([(1, "head", "alphaBeta beta"), (2, None, "beta"), (3, "x", None)], "doc_id bigint, heading string, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert run("test_predictions_all") == [(9, 1), (9, 2)]
    assert run("text_vocabulary") == [(1, "alpha"), (2, "beta")]
