"""Evaluation texts inside a training corpus (problem 7).

Each shard of the corpus, which is a batch of one partition, gets a suffix array over its words, in the full
order of the suffixes. Every suffix of the test items is searched in it by bisection, which gives the suffixes of the shard
that begin by the same words; their common prefixes are the longest verbatim matches. The affected documents can then be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import spread

#: Consecutive words that make a leak.
MIN_WORDS = 12
#: Words of a shard for which one suffix array is built.
SHARD_WORDS = 2_000_000
#: Bytes of the items' texts up to which they are broadcast; more are dealt out to the tasks by a shuffle.
BROADCAST_BYTES = 16_000_000
#: Bytes of the items' texts that one task holds where they are dealt out.
HELD_BYTES = 64_000_000
#: Words compared at once.
STRIDE = 16
_WORD = re.compile(r"[^\W_]+")


class Vocabulary(dict):
    """A stretch of text without white space → its words' numbers in the test items' vocabulary; 0 for all other words."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__()
        self.numbers = numbers
        self.start, self.length, self.flat = [], [], []

    def __missing__(self, stretch: str) -> int:
        ids = [self.numbers.get(w.casefold(), 0) for w in _WORD.findall(stretch)]
        number = self[stretch] = len(self.start)
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        return number


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, without regard to case."""
    return [w.casefold() for w in _WORD.findall(text or "")]


class TestSet:
    """Test items as word numbers from 1, one after the other, each followed by -1, and all their suffixes that can be a leak's start."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.numbers: dict[str, int] = {}
        flat, self.items, places, which, needed, begins = [], [], [], [], [], []
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if ids:
                n = min(least, len(ids))
                places.append(len(flat) + np.arange(len(ids) - n + 1))
                which.append(np.full(len(ids) - n + 1, len(self.items)))
                needed.append(np.full(len(ids) - n + 1, n))
                begins.append(len(flat))
                self.items.append(item)
                flat += [*ids, -1]
        none = [np.zeros(0, np.int64)]
        self.flat = np.array(flat + [-1] * STRIDE, np.int64)
        self.places, self.which, self.needed = (np.concatenate(x or none) for x in (places, which, needed))
        self.begins = np.array(begins, np.int64)
        self.shortest = int(self.needed.min()) if len(self.needed) else 0


def common_prefix(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Words that a from each place of at and b from the place of bt beside it have in common.

    The words behind a's and b's last are nowhere in the other. With most, no more than so many words, rounded up to STRIDE, are compared.
    """
    out = np.zeros(len(at), np.int64)
    going = np.arange(len(at))
    steps = np.arange(STRIDE)
    while len(going):
        done = out[going]
        same = a[np.minimum((at[going] + done)[:, None] + steps, len(a) - 1)] == b[np.minimum((bt[going] + done)[:, None] + steps, len(b) - 1)]
        count = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
        out[going] += count
        going = going[(count == STRIDE) if most is None else (count == STRIDE) & (done + STRIDE < most[going])]
    return out


def suffix_array(flat: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The places of flat with left > 0 in the full order of their suffixes, which end at the next 0.

    left: words up to that 0. The first words give a rank; ranks of places and of the places so many words
    further on give those of twice as many words, for the places whose rank is still shared and whose
    suffix goes on. Equal suffixes keep the order of their places.
    """
    n = len(flat)
    bits = max(1, int(flat.max()).bit_length())
    width = min(63 // bits, 8)
    padded = np.concatenate([flat, np.zeros(width, flat.dtype)])
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for k in range(width):
        word = padded[k : k + n]
        ended |= word == 0
        key = key << bits | np.where(ended, 0, word)
    places = np.flatnonzero(left > 0)
    order = places[np.argsort(key[places], kind="stable")]
    rank = np.zeros(n + 1, np.int64)  # 0 for the empty suffix

    # a rank is one more than the slot of the first place that has it
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(order)))
    rank[order] = np.repeat(starts, sizes) + 1
    # the slots whose rank is shared by suffixes that go on; a rank is shared by such ones only or by ended ones only
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes) & (left[order] >= width))
    span = width
    while len(slots):
        there = order[slots]
        group, further = rank[there], rank[np.minimum(there + span, n)]
        # slots ascend with their group, so the reordered places go back into them; a suffix that ends here comes first
        again = np.lexsort((there, further, group))
        there, group, further = there[again], group[again], further[again]
        order[slots] = there
        fresh = np.ones(len(there), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(there)))
        rank[there] = np.repeat(slots[starts], sizes) + 1
        span *= 2
        slots = slots[np.repeat(sizes > 1, sizes) & (left[there] >= span)]
    return order


def search(tests: TestSet, flat: np.ndarray, array: np.ndarray, after: bool) -> np.ndarray:
    """For each test suffix's needed words the first place in the array whose suffix isn't less, or doesn't begin by them either if after. All are searched at once."""
    low, high = np.zeros(len(tests.places), np.int64), np.full(len(tests.places), len(array), np.int64)
    while (going := np.flatnonzero(low < high)).size:
        middle = (low[going] + high[going]) >> 1
        p, q, needed = tests.places[going], array[middle], tests.needed[going]
        same = np.minimum(common_prefix(tests.flat, p, flat, q, needed), needed)
        whole = same == needed
        before = np.where(whole, after, flat[q + same] < tests.flat[p + same])
        low[going[before]] = middle[before] + 1
        high[going[~before]] = middle[~before]
    return low


def shard_matches(tests: TestSet, flat: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Columns of document's number, item's number, place in item, place in document and words of each longest match of a shard.

    flat: word numbers of all documents, each followed by a 0. Of several matches of a document and an
    item the longest counts, then the first in the item, then in the document.
    """
    none = np.zeros((0, 5), np.int64)
    ends = np.flatnonzero(flat == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(flat))
    if not len(tests.places) or not (left >= tests.shortest).any():
        return none
    array = suffix_array(flat, left)
    # a suffix of too few words before the next foreign one can't match
    array = array[left[array] >= tests.shortest]
    flat = np.concatenate([flat, np.zeros(STRIDE, flat.dtype)])
    low, high = (search(tests, flat, array, after) for after in (False, True))
    sizes = high - low
    suffix = np.repeat(np.arange(len(sizes)), sizes)
    spot = array[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(len(suffix))]
    place = tests.places[suffix]
    # a match that the word before also belongs to is found from there
    whole = (tests.flat[place - 1] != flat[spot - 1]) | (place == tests.begins[tests.which[suffix]]) | (spot == 0)
    suffix, spot, place = suffix[whole], spot[whole], place[whole]
    if not len(suffix):
        return none
    length = common_prefix(tests.flat, place, flat, spot)
    item, doc = tests.which[suffix], owner[spot]
    order = np.lexsort((spot, place, -length, item, doc))
    first = np.ones(len(order), bool)
    first[1:] = (doc[order[1:]] != doc[order[:-1]]) | (item[order[1:]] != item[order[:-1]])
    best = order[first]
    return np.stack([doc[best], item[best], (place - tests.begins[item])[best], (spot - begins[doc])[best], length[best]], axis=1)


_TESTS: list[tuple[list, int, TestSet]] = []


def _shared_tests(shared: Broadcast, least: int) -> TestSet:
    """The test items of a broadcast, made once in a worker process."""
    if not _TESTS or _TESTS[0][0] is not shared.value or _TESTS[0][1] != least:
        _TESTS[:] = [(shared.value, least, TestSet(shared.value, least))]
    return _TESTS[0][2]


class _Searcher:
    """Searches one set of items in documents, batch by batch."""

    def __init__(self, tests: TestSet, names: list[str], item_arrow: pa.DataType) -> None:
        self.tests, self.names, self.item_arrow = tests, names, item_arrow
        self.vocabulary = Vocabulary(tests.numbers)

    def batch(self, ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(texts):
            flat, end, total = [], at, 0
            while end < len(texts) and (end == at or total < SHARD_WORDS):
                numbers = np.fromiter(map(self.vocabulary.__getitem__, texts[end].split()), np.int64)
                flat.append(numbers)
                total += len(numbers)
                end += 1
            yield _search_shard(self.tests, self.vocabulary, flat, ids.slice(at, end - at), self.names, self.item_arrow)
            at = end
        if len(self.vocabulary) > 500_000:
            self.vocabulary = Vocabulary(self.tests.numbers)


def _dealt(corpus: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """__slot, __kind, id, item, text: each block of items beside each stretch of documents, items first.

    Blocks are of about HELD_BYTES; the documents are read once and moved once for each block.
    """
    stretches, blocks = corpus.sparkSession.sparkContext.defaultParallelism, -(-size // HELD_BYTES)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = corpus.select("*", all_of(blocks).alias("__b")).select((number("__text", stretches) * blocks + F.col("__b")).alias("__slot"), F.lit(1).alias("__kind"), F.col("__doc"), F.lit(None).cast(wanted.schema["i"].dataType).alias("i"), "__text")
    items = wanted.select("*", all_of(stretches).alias("__s")).select((F.col("__s") * blocks + number("i", blocks)).alias("__slot"), F.lit(0).alias("__kind"), F.lit(None).cast(corpus.schema["__doc"].dataType).alias("__doc"), "i", F.col("t").alias("__text"))
    return docs.unionByName(items).repartition(stretches * blocks, "__slot").sortWithinPartitions("__slot", "__kind")


def find_matches(
    documents: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Longest verbatim match of each document with each item that it leaks.

    Columns: id_column, item_id, n_words, item_word and doc_word (places of the match, from 0). A leak
    is a run of at least min_words common words or, for an item of fewer words, the whole item. Words are
    runs of letters and digits without regard to case. Null and empty texts and items without a word
    leak nothing. Equal items each come out, equal documents too. Items of at most BROADCAST_BYTES are broadcast, and the
    documents are searched where they are; more items are dealt out in blocks beside the documents. Either way
    the documents are read once.
    """
    kind, item_kind = documents.schema[id_column].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    names = [id_column, item_id, "n_words", "item_word", "doc_word"]
    schema = f"`{id_column}` {kind}, `{item_id}` {item_kind}, n_words int, item_word int, doc_word int"
    corpus = documents.select(F.col(id_column).alias("__doc"), F.col(text_column).cast("string").alias("__text")).filter("__text is not null and __text <> ''")
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    item_arrow = pa.int64() if item_kind == "bigint" else pa.string() if item_kind == "string" else pa.int32()
    size = wanted.agg(F.sum(F.octet_length("t") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = corpus.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in wanted.collect()])

        def run(batches):
            searcher = _Searcher(_shared_tests(shared, min_words), names, item_arrow)
            for batch in batches:
                yield from searcher.batch(batch.column(0), batch.column(1).to_pylist())

        return spread(corpus).mapInArrow(run, schema)

    def run_dealt(batches):
        slot, held, searcher = None, [], None
        for batch in batches:
            slots, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(slots) | np.diff(kinds)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if slots[a] != slot:
                    slot, held, searcher = slots[a], [], None
                texts = batch.column(4).slice(a, b - a).to_pylist()
                if kinds[a] == 0:
                    held.extend(zip(batch.column(3).slice(a, b - a).to_pylist(), texts))
                    continue
                searcher = searcher or _Searcher(TestSet(held, min_words), names, item_arrow)
                yield from searcher.batch(batch.column(2).slice(a, b - a), texts)

    return _dealt(corpus, wanted, size).mapInArrow(run_dealt, schema)


def _search_shard(tests: TestSet, vocabulary: Vocabulary, stretches: list[np.ndarray], ids: pa.Array, names: list[str], item_arrow: pa.DataType) -> pa.RecordBatch:
    start, length, table = np.array(vocabulary.start, np.int64), np.array(vocabulary.length, np.int64), np.array([*vocabulary.flat, 0], np.int64)
    numbers = np.concatenate([*stretches, np.zeros(0, np.int64)])
    lengths = length[numbers]
    ends = np.cumsum(lengths)
    gathered = table[np.repeat(start[numbers] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
    counts = np.add.reduceat(np.append(lengths, 0), np.minimum(np.cumsum([0, *map(len, stretches)])[:-1], len(lengths)))
    counts = np.where([len(s) > 0 for s in stretches], counts, 0)
    # each document is followed by a 0
    begins = np.cumsum(counts + 1) - (counts + 1)
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    flat = np.zeros(len(owner), np.int64)
    flat[np.arange(len(gathered)) + np.repeat(np.arange(len(counts)), counts)] = gathered
    found = shard_matches(tests, flat, owner, begins)
    docs = ids.take(pa.array(found[:, 0]))
    items = pa.array([tests.items[i] for i in found[:, 1].tolist()], item_arrow)
    rest = [pa.array(found[:, k], pa.int32()) for k in (4, 2, 3)]
    return pa.RecordBatch.from_arrays([docs, items, *rest], names=names)


def remove_affected(documents: DataFrame, matches: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """documents without those that leak an item. A null id is kept, since it can't be in matches by value."""
    return documents.join(matches.select(id_column).distinct(), id_column, "left_anti")
