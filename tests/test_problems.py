"""Orphan references, interval gaps and nested records on small tables with every awkward case."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgrain.operators import intervals as iv
from loomgrain.operators import nested, references

T0 = datetime(2024, 1, 1)
hours = lambda h: T0 + timedelta(hours=h)

LEDGER = "id bigint, tx_id string, committed_at timestamp, loaded_at timestamp, n int"
TX = "tx_id string, loaded_at timestamp, n int"
TOMBS = "tx_id string, tombstone_hlc string"


def ledger(spark, rows, tx, tombs):
    found = references.ledger_orphans(spark.createDataFrame(rows, LEDGER), spark.createDataFrame(tx, TX), spark.createDataFrame(tombs, TOMBS))
    return sorted(r["__id"] for r in found.collect())


def test_orphans_of_each_kind(spark):
    millis = int((hours(5) - datetime(1970, 1, 1)).total_seconds() * 1000)
    rows = [
        (1, " A ", T0, hours(3), 0),  # spelled otherwise
        (2, "never", T0, hours(3), 0),
        (3, "a", T0, hours(1), 0),  # before its parent
        (4, "a", T0, hours(5), 0),  # deleted at that instant
        (5, None, T0, hours(3), 0),  # no reference
        (6, "", T0, hours(3), 0),  # empty text is one
        (7, "a", None, hours(4), 0),
        (8, "x", None, None, 0),
        (None, "x", T0, hours(3), 0),
        (9, "a", T0, hours(3), 0),
        (9, "never", T0, hours(4), 0),  # redelivered later: doesn't count
        (9, "a", T0, hours(3), 0),
    ]
    assert ledger(spark, rows, [("a", hours(2), 0), ("A", hours(9), 0), (None, hours(1), 0)], [("A ", f"{millis}-0001-n-b"), ("a", "bad"), (None, "1-0-x")]) == [2, 3, 4, 6, 8]


def test_orphans_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", T0, hours(3), 0) for i in range(3000)]
    found = ledger(spark, rows, [("hot", hours(4), 0)] + [(f"k{i}", hours(1), 0) for i in range(0, 3000, 6)], [])
    assert found == [i for i in range(3000) if i % 3 or i % 6]


def test_orphans_of_empty_tables(spark):
    assert ledger(spark, [], [], []) == []
    assert ledger(spark, [(1, "a", T0, hours(1), 0)], [], []) == [1]


def brute_periods(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(p) for p in out]


@pytest.mark.parametrize("slice_us", [7, 1_000_000])
def test_gaps_and_periods_equal_brute_force(spark, slice_us):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randrange(6)}", s := rng.randrange(-50, 300), s + rng.randrange(-2, 12)) for _ in range(400)]
    rows += [("one", 5, 9), ("touch", 1, 3), ("touch", 3, 5), ("same", 1, 2), ("same", 1, 2), (None, 1, 2), ("open", 1, None), ("never", None, 3), ("", 1, 2), ("", 4, 5)]
    df = spark.createDataFrame(rows, "entity string, a bigint, b bigint")
    spans = iv.intervals(df, "entity", F.col("a"), F.col("b"))
    expected_gaps, expected_periods = set(), set()
    for entity in {r[0] for r in rows if r[0] is not None}:
        periods = brute_periods([(s, e) for n, s, e in rows if n == entity and s is not None and e is not None and e > s])
        expected_periods |= {(entity, *p) for p in periods}
        expected_gaps |= {(entity, p[1], q[0]) for p, q in zip(periods, periods[1:])}
    got = [tuple(r) for r in iv.gaps(spans, slice_us).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_gaps
    assert {tuple(r) for r in iv.periods(spans, slice_us).collect()} == expected_periods
    assert iv.gaps(spans.limit(0)).count() == 0


PACKET = {"schemaVersion": "v1", "changes": [{"path": "a", "symbols": [{"name": "x"}, None, {"kind": "t"}]}, None, {"path": None, "symbols": {"name": "lone"}}], "relevantDecisions": [{"stalenessTier": "WARNING"}, {"stalenessTier": None}, {"staleness_tier": "critical"}], "sdk": {"changes": [{"path": "decoy"}]}}
RECORDS = [("change", -1, 0, "a"), ("change", -1, 2, None), ("decision", -1, 0, "warning"), ("decision", -1, 2, "critical"), ("symbol", 0, 0, "x"), ("symbol", 0, 2, None), ("symbol", 2, 0, "lone")]
TEXT = json.dumps(PACKET)
WRAPPED = [
    TEXT,
    "﻿" + TEXT,
    json.dumps(TEXT),
    json.dumps(json.dumps(TEXT)),
    json.dumps({"packet": PACKET}),
    json.dumps({"packet": TEXT}),
    json.dumps({"kind": "impact", "payload": {"changes": None, "packet": PACKET}}),
    json.dumps([PACKET]),
    json.dumps({"meta": {"id": 1}, "envelope": {"inner": PACKET}}),
    json.dumps(PACKET, indent=2),
    json.dumps({("schema_version" if k == "schemaVersion" else k): v for k, v in reversed(PACKET.items())}),
]


def test_packets_mean_the_same_however_wrapped(spark):
    bad = [None, "", "null", "[]", "{}", TEXT[:-1], TEXT + "x", "packet unavailable", '"' + TEXT, "[" * 5000, "3", '""']
    rows = [(i, t, "extra") for i, t in enumerate(WRAPPED + bad)] + [(0, TEXT, "redelivered"), (None, TEXT, "no id")]
    df = spark.createDataFrame(rows, "id bigint, packet_json string, value string")
    out = sorted(tuple(r) for r in nested.packet_records(df).collect())
    for i in range(len(WRAPPED)):
        assert sorted((r[1:] for r in out if r[0] == i), key=str) == sorted(RECORDS, key=str), i
    assert {r[0] for r in out} == set(range(len(WRAPPED)))


def test_flat_tables_keep_links(spark):
    df = spark.createDataFrame([(7, TEXT)], "id bigint, packet_json string")
    found = nested.shred(df, "id", "packet_json")
    symbols = sorted(nested.flat_table(found, "symbol").select("__id", "parent_pos", "pos", "name", "kind").collect())
    assert [tuple(r) for r in symbols] == [(7, 0, 0, "x", None), (7, 0, 2, None, "t"), (7, 2, 0, "lone", None)]
    assert nested.flat_table(found, "change").count() == 2


@pytest.mark.parametrize("text", ["", "[", "[1,]", '{"a":1,}', "[01]", "1 2", '{"a":1 "b":2}', "[}", "nul", '{"a"}', "[,1]", "{,}", "-", '"abc', "[1 2]", "tru", "truex", "[NaN]", "[1.5e3,-0,true]", '{"a":1,"b":"x","c":null}', '{"a":"b","c":tru}', '{"a":"b","c":1 2}', '{"a":"b","c":01}', '{"a":"b"]', '[{"a":"b"}', '[{"a":"b"}}', '{"a":"\x01"}', '{"a":"b"}, 1', '[\uff11]', '{"a":\uff11}', '{"a" : [ ] , "b":{ } }', ' [ [ ] ] ', '"\\ud83d"'])
def test_events_accept_exactly_json(text):
    def fine(parse):
        try:
            parse()
        except (ValueError, ZeroDivisionError):
            return False
        return True

    right = fine(lambda: json.loads(text, parse_constant=lambda c: 1 / 0))
    assert fine(lambda: list(nested.events(text))) == fine(lambda: list(nested.triples(text))) == right
