"""Operators for text corpora and large columns against brute force, public libraries and awkward cases."""

import base64
import math
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")

from loomgrain.llm import bpe, confusables, leakage, selection, splitting  # noqa: E402
from loomgrain.llm.encoding import encode  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "a b  \n\t\r'sé 　日本語1２²_-.…ßaaababab\x1c\x85​👍🏽́<|endoftext|>"
ODD = ["", " ", "  ", "a ", "x \n y", "\n" * 99, "a" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>", "don't we'll", "日本語" * 2000]


def texts(n, size=60):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)] + ODD


def test_encoder_equals_public_library(reference):
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY))
    all_texts = texts(3000)
    for part in (all_texts[:1000], all_texts[1000:], all_texts[:500]):
        offsets, ids = enc.encode_many(part)
        for i, text in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(text)
    assert enc.counts(ODD).tolist() == [len(reference.encode_ordinary(t)) for t in ODD]


def test_store_starts_anew_beyond_its_bound(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 10)
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY))
    for text in texts(100):
        _, ids = enc.encode_many([text])
        assert ids.tolist() == reference.encode_ordinary(text)


def test_encode_keeps_every_row(spark, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "a  b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = [(r.doc_id, r.ids) for r in encode(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(out, key=key) == sorted([(i, reference.encode_ordinary(t or "")) for i, t in rows], key=key)
    assert encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["word " * 9000, "日本語。" * 3000, "a" * 20000, "\n" * 30000, "👍🏽" * 4000, "One line.\n\nTwo lines here. And more.\n" * 900, "x " * 2048])
def test_pieces_cover_text_within_limit(reference, text):
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY))
    pieces = splitting.split_text(text, enc)
    total = len(reference.encode_ordinary(text))
    assert (len(pieces) > 1) == (total > splitting.LIMIT)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n, _, _ in pieces:
        assert n == len(reference.encode_ordinary(text[a:b])) <= splitting.LIMIT
    for p, q in zip(pieces, pieces[1:]):
        assert p[0] < q[0] <= p[1] < q[1]
        assert q[4] == p[1] - q[0]
        assert 90 <= len(reference.encode_ordinary(text[q[0] : p[1]])) <= 170 or text[0] in "a\n"


def test_pieces_end_at_natural_boundaries():
    text = "\n\n".join("This is a sentence of some words. " * 12 for _ in range(60))
    pieces = splitting.split_text(text, bpe.encoder())
    assert all(kind == splitting.PARAGRAPH for *_, kind, _ in pieces)


def test_split_oversized_rows(spark):
    rows = [(1, "w " * 5000), (2, "w"), (3, None), (4, ""), (5, "w " * 5000)]
    out = splitting.split_oversized(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in out} == {1, 5}
    assert all(r.piece == dict(rows)[r.doc_id][r.start_char : r.end_char] for r in out)
    assert len(out) == 2 * out[0].n_pieces


def brute_leaks(docs, items, least):
    words = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", t or "")]
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(least, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(item)
    out = set()
    for doc, text in docs:
        w = words(text)
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                out |= {(doc, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab cd e_f g,h ß SS ss 1"
    make = lambda n, size: [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, size)))) for i in range(n)]
    docs, items = make(60, 80) + [(100, None), (101, "")], make(9, 20) + [(50, None), (51, "??")]
    docs += [(102 + i, docs[0][1]) for i in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.find_matches(d, i, min_words=4)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute_leaks(docs, items, 4)
    clean = {r.doc_id for r in leakage.remove_affected(d, found).collect()}
    assert clean == {x for x, _ in docs} - {r.doc_id for r in rows}


def test_longest_match_and_places(spark):
    docs = spark.createDataFrame([(1, "x one two three four FIVE y"), (2, "one two")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "zero one-two three; four five six"), (8, "Two")], "item_id bigint, text string")
    rows = sorted(tuple(r) for r in leakage.find_matches(docs, items, min_words=3).collect())
    assert rows == [(1, 7, 5, 1, 1), (1, 8, 1, 0, 2), (2, 8, 1, 0, 1)]
    assert leakage.find_matches(docs, items.limit(0)).count() == 0


def brute_percentiles(rows, percents):
    groups = defaultdict(list)
    for k, day, v in rows:
        if v is not None:
            groups["day", k, day].append(v)
            groups["all", k, None].append(v)
    return {(s, k, d, p, sorted(v)[max(1, math.ceil(len(v) * p / 100)) - 1], len(v)) for (s, k, d), v in groups.items() for p in percents}


@pytest.mark.parametrize("block,broadcast", [(1_000_000, 100_000), (8, 0)])
def test_percentiles_equal_sorting(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(selection, "BLOCK_ROWS", block)
    monkeypatch.setattr(selection, "BROADCAST_RANGES", broadcast)
    rng = random.Random(block)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", None, "b"]), f"d{rng.randrange(3)}", rng.choice([None, 0, 5, rng.randrange(10**6), int(rng.paretovariate(0.3)) % 10**15])) for _ in range(900)]
    rows += [("single", "d0", 7), ("nulls", "d0", None), ("ties", "d1", 4), ("ties", "d1", 4), ("edge", None, -(1 << 63)), ("edge", None, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "k string, day string, v bigint").repartition(3)
    out = selection.percentiles_by_day(df, ["k"], "day", "v", (1, 50, 99, 100))
    got = [(r.scope, r.k, r.day, r.p, r.value, r.n) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_percentiles(rows, (1, 50, 99, 100))
    assert selection.percentiles_by_day(df.limit(0), ["k"], "day", "v").count() == 0


def test_script_sets():
    assert confusables.resolved_scripts("sсope") == frozenset()
    assert confusables.consistent_spelling("sсope") == ("scope", "mixed")
    assert confusables.consistent_spelling("сор") == ("cop", "whole")
    assert confusables.consistent_spelling("обзop")[0] == "обзор"
    assert confusables.consistent_spelling("архив")[1] == "plain"


SAME = [
    ("src/app.rs", "ｓｒｃ／ａｐｐ．ｒｓ"),
    ("docs/a\u00f1o.md", "docs/an\u0303o.md"),
    ("docs/plan b.md", "docs/plan b.md"),
    ("docs/plan.md", "\ufeffdo\u200bcs/pl\u00adan.md\u200e"),
    ("scope", "ѕсоре"),
    ("docs/обзор", "docs/oбзop"),
    ("docs/\u03b4\u03b5\u03af\u03b3\u03bc\u03b1", "d\u043ecs/\u03b4\u03b5\u03b9\u0301\u03b3\u03bc\u03b1"),
    ("config", "conﬁg"),
    ("a/b", "a∕b"),
    ("code", "𝚌𝚘𝚍𝚎"),
    ("docs/ガイド", "docs/ｶﾞイド"),
    ("x.y", "x․y"),
]
DIFFERENT = [("src/App", "src/app"), ("a/b", "a//b"), ("a/b", "a\\b"), ("./a", "a"), ("naïve", "naive"), ("çıktı", "çikti"), ("x2", "x²"), ("l1", "ll"), ("O0", "00"), ("größe", "grösse"), ("k", "к"), ("э", "ε")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert confusables.visible_form(a) == confusables.visible_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert confusables.visible_form(a) != confusables.visible_form(b)


def test_form_is_stable():
    for a, b in SAME + DIFFERENT:
        for t in (a, b):
            assert confusables.visible_form(confusables.visible_form(t)) == confusables.visible_form(t)


def test_spelled_files(spark):
    files = spark.createDataFrame([(1, "src/app.rs", "x"), (2, "docs/año.md", "x"), (3, None, "x")], "id bigint, file_path string, entity string")
    rows = [("t1", "src/app.rs", "ѕrc/app.rs"), ("t1", "src/app.rs", "ѕrc/app.rs"), ("t2", None, "docs/an\u0303o.md"), ("t3", "SRC/APP.RS", ""), (None, "src/app․rs", None)]
    tx = spark.createDataFrame(rows, "tx_id string, entity string, entity_normalized string")
    out = sorted((tuple(r) for r in confusables.spelled_files(tx, files).collect()), key=str)
    assert out == sorted([("t1", "entity_normalized", 1), ("t2", "entity_normalized", 2), (None, "entity", 1)], key=str)
    assert confusables.spelled_files(tx.limit(0), files).count() == 0
    assert confusables.spelled_files(tx, files.limit(0)).count() == 0


def test_gather_of_nothing():
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY))
    assert enc.gather(np.zeros(0, np.int64)).tolist() == []
    assert [x.tolist() for x in enc.encode_many([])] == [[0], []]


def test_runs_stay_within_their_bound_and_every_group_goes_through_rounds(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK_ROWS", 6)
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.lit("d").alias("day"), F.pmod(F.xxhash64("id"), F.lit(10**15)).alias("v")).repartition(40)
    sizes = [r.n for r in selection.sorted_runs(df, ["k", "day"], "v").select(F.size("run").alias("n")).collect()]
    assert max(sizes) == 6 and sum(sizes) == 4000
    rounds = {}
    got = {(r.scope, r.p): r.value for r in selection.percentiles_by_day(df, ["k"], "day", "v", (50, 99), rounds).collect()}
    v = sorted(r.v for r in df.collect())
    assert got == {(s, p): v[4000 * p // 100 - 1] for s in ("day", "all") for p in (50, 99)}
    assert len(rounds["day"]) > 3 and rounds["all"]


def test_percentiles_of_huge_values(spark):
    v = [-(2**63), 2**63 - 1, 0, 2**62, 2**62 + 1, 2**62 + 2, -1, -(2**63) + 1] * 3
    df = spark.createDataFrame([(None, "d", x) for x in v], "k string, day string, v bigint").repartition(3)
    got = {(r.scope, r.p): r.value for r in selection.percentiles_by_day(df, ["k"], "day", "v", (1, 50, 75, 100)).collect()}
    s = sorted(v)
    assert got == {(x, p): s[max(1, math.ceil(24 * p / 100)) - 1] for x in ("day", "all") for p in (1, 50, 75, 100)}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_in_full_order(seed):
    rng = np.random.default_rng(seed)
    flat = rng.integers(0, [2, 3, 5, 50, 70_000, 2][seed], 400)
    if seed == 5:
        flat = np.append(np.tile(np.append(np.ones(60, int), [2, 3]), 5), 0)
    flat = np.append(flat, 0).astype(np.int64)
    ends = np.flatnonzero(flat == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(flat))
    suffix = lambda i: tuple(flat[i : i + left[i]].tolist())
    got = leakage.suffix_array(flat, left).tolist()
    assert got == sorted((i for i in range(len(flat)) if left[i]), key=lambda i: (suffix(i), i))


def test_leaks_of_dealt_items_equal_broadcast_ones(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda n, size: [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, size)))) for i in range(n)]
    d, i = spark.createDataFrame(make(80, 60), "doc_id bigint, text string"), spark.createDataFrame(make(30, 20), "item_id bigint, text string")
    near = sorted(map(tuple, leakage.find_matches(d, i, min_words=4).collect()))
    monkeypatch.setattr(leakage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(leakage, "HELD_BYTES", 1000)
    assert near and sorted(map(tuple, leakage.find_matches(d, i, min_words=4).collect())) == near


#: For each script a word of letters of it alone, and the Latin text that it shows.
WHOLE_SCRIPT = {
    "Cyrillic": ("сора", "copa"), "Greek": ("ΝΟΤΕ", "NOTE"), "Armenian": ("սոհ", "unh"), "Cherokee": ("ᎡᎪᏴ", "RAB"), "Coptic": ("ⲞⲤ", "OC"),
    "Hebrew": ("סס", "oo"), "Arabic": ("هه", "oo"), "Devanagari": ("००", "oo"), "Telugu": ("౦౦", "oo"), "Lao": ("໐໐", "oo"), "Myanmar": ("ဝဝ", "oo"),
    "Tifinagh": ("ⵔⴹ", "OE"), "Lisu": ("ꓡꓳꓖ", "LOG"), "Canadian_Aboriginal": ("ᐯᑭᒪ", "VPL"), "Deseret": ("𐐬𐐬", "oo"), "Georgian": ("ყ", "y"),
}


@pytest.fixture(scope="module")
def looks(spark):
    return confusables.Looks(*confusables.public_looks(spark).value)


@pytest.mark.parametrize("script", WHOLE_SCRIPT)
def test_whole_script_words_show_latin_ones(looks, script):
    import regex

    word, shown = WHOLE_SCRIPT[script]
    assert regex.fullmatch(rf"\p{{scx={script}}}+", word)
    assert confusables.visible_form(word, looks) == shown
    assert confusables.visible_form(f"src/{word}.rs", looks) == f"src/{shown}.rs"


def test_public_groups_keep_apart_what_is_seen(looks):
    groups = set(looks.alike.values())
    for g in groups:
        assert sum(c.isascii() for c in g) <= 1, g
        assert not any(c.lower() != c and c.lower() in g and c.lower() in confusables.public_groups({})[0][0] for c in g)
    for a, b in [("l", "I"), ("l", "1"), ("O", "0"), ("o", "O"), ("i", "ı"), ("з", "3"), ("б", "6"), ("/", "\\"), ("v", "V"), ("rn", "m"), ("|", "l"), ("a.b", "a,b")]:
        assert confusables.visible_form(a + "é", looks) != confusables.visible_form(b + "é", looks), (a, b)
    assert len(looks.alike) > 1000


def test_each_public_letter_gets_its_group(spark, looks):
    skeleton = confusables.skeletons(spark)
    listed = [c for c, s in skeleton.items() if s.isascii() and s.isalpha() and s not in "lO" and unicodedata.category(c) in ("Ll", "Lu", "Lo") and c not in confusables.NOT_ALIKE]
    odd = [c for c in listed if confusables.visible_form(c, looks) != skeleton[c]]
    # letters in both cases, of which the small one stays
    assert len(listed) > 300 and len(odd) <= 8, odd


@pytest.mark.parametrize("seed", range(8))
def test_pieces_end_at_boundaries_before_an_unbroken_run(seed):
    rng = random.Random(seed)
    enc = bpe.encoder()
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(n))
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.choice([300, 700, 9000])))
    text = words(rng.randrange(1200, 1700)) + " " + run + " " + words(rng.randrange(1, 900))
    pieces = splitting.split_text(text, enc)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and max(p[2] for p in pieces) <= 2048
    for (a, b, _, kind, _), (c, *_) in zip(pieces, pieces[1:]):
        assert a < c <= b
        assert kind > 0 or len(run) > 1000
    assert pieces[0][3] > 0


def test_long_runs_of_marks_stay_with_their_letter():
    text = "a" * 300 + ("b" + "\u0301" * 500) * 12
    for a, b, *_ in splitting.split_text(text, bpe.encoder(), 2048, 128)[1:]:
        assert text[a] != "\u0301"
