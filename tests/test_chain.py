"""Hash chains of every shape, walked step by step for comparison, and what a walk leaves on disk."""

import hashlib
import random

import pytest

from loomgrain.operators import graph

SCHEMA = "hash string, prev string, n bigint"


def walked(rows):
    """hash → place, one step at a time."""
    heirs = {}
    for h, prev, _ in rows:
        if prev is not None and h is not None and prev != h:
            heirs[prev] = min(h, heirs.get(prev, h))
    places = {r[0]: None for r in rows}
    first = sorted((n, h) for h, prev, n in rows if prev is None)
    at, place = first[0][1] if first else None, 0
    while at is not None and at in places and places[at] is None:
        places[at] = place
        at, place = heirs.get(at), place + 1
    return places


def shape(kind):
    r = random.Random(kind)
    name = (lambda i: hashlib.sha256(str(i).encode()).hexdigest()) if kind != "words" else (lambda i: ("ab" * (i % 3) + f"{i:x}", f"AB{i:04x}", f"{i:04x}\n", f"ü{i}")[i % 4])
    rows = [(name(i), name(i - 1) if i else None, i) for i in range(400)]
    if kind in ("forks", "words"):
        rows += [(f"{'~!0z'[i % 4]}{i}", name(r.randrange(500)), i) for i in range(200)]
    if kind == "no order":
        rows = [(h, p, r.randrange(50)) if p else (h, p, 0) for h, p, n in rows]
    if kind == "broken":
        rows = [(h, None if n % 90 == 7 else name(n + 9000) if n == 250 else p, n) for h, p, n in rows]
    if kind == "twice":  # hashes with two predecessors, one of them elsewhere, and rows that repeat
        rows += [(name(i), f"lost{i}", -5) for i in range(0, 400, 40)] + [(f"lost{i}", f"lost{i - 1}", 1000 + i) for i in range(400)] + rows[50:60]
    if kind == "entered":  # the chain goes on in the midst of another one
        rows = [x for x in rows if x[2] != 200] + [(name(5000 + i), name(4999 + i), 5000 + i) for i in range(100)] + [(name(5050), name(199), 1)]
    if kind == "ring":
        rows += [(name(100), name(399), 9999)] + [(f"r{i}", f"r{(i - 1) % 50}", i) for i in range(50)]
    if kind == "no genesis":
        rows = rows[1:]
    if kind == "nulls":
        rows += [(None, name(3), 3), (None, None, 900), (name(77), name(77), 77), (name(901), None, 901)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["whole", "forks", "words", "no order", "broken", "twice", "entered", "ring", "no genesis", "nulls"])
@pytest.mark.parametrize("at_once, run_rows", [(1_000_000, 200_000), (50, 1)])
def test_chain_equals_single_steps(spark, kind, at_once, run_rows):
    """Also with links thinned out in rounds, which at_once and Arrow batches of 3 rows bring about."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if run_rows == 1 else 10_000)
    rows = shape(kind)
    found = graph.walk_chain(spark.createDataFrame(rows, SCHEMA), "n", at_once=at_once, run_rows=run_rows).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({r["hash"] for r in found})
    assert {r["hash"]: r["place"] for r in found} == walked(rows)


def test_empty_chain(spark):
    assert graph.walk_chain(spark.createDataFrame([], SCHEMA), "n").collect() == []


def test_a_walk_writes_few_bytes(spark, monkeypatch):
    """What is written for good doesn't grow by the logarithm of the chain's length: in order it is the keys alone."""
    written = []
    cut = graph.cut

    def counted(df):
        out = cut(df)
        written.append(sum(len(bytes(v)) if isinstance(v, (bytes, bytearray)) else len(v) if isinstance(v, str) else 8 for row in out.collect() for v in row if v is not None))
        return out

    monkeypatch.setattr(graph, "cut", counted)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), hashlib.sha256(str(i - 1).encode()).hexdigest() if i else None, i) for i in range(3000)]
    assert {r["hash"]: r["place"] for r in graph.walk_chain(spark.createDataFrame(rows, SCHEMA), "n").collect()} == {h: n for h, _, n in rows}
    assert sum(written) < 32 * len(rows)


def test_equal_keys_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "KEY", 1)
    with pytest.raises(Exception, match="two hashes have the same key"):
        graph.walk_chain(spark.createDataFrame(shape("whole"), SCHEMA), "n").collect()
