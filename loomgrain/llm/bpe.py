"""Byte-level BPE over whole partitions by an index from each pair to all its positions.

A text is cut into pretokens; every pretoken not met before waits in a list. For the waiting
pretokens of a batch one index is made from each pair of neighbouring symbols to all its positions.
The active ranks are then applied in ascending order, each to all positions of its pair at once, and
the lists of the neighbouring pairs are updated. Results are kept by text chunk, so that a chunk met
again costs one dictionary lookup.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from pathlib import Path

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Fixed value: the pattern by which the vocabulary's texts are cut before merging.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space that no visible character follows stays inside its chunk; a lone surrogate stands for it, which no UTF-8 text holds.
_INNER = "\udc00"
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")
#: Chunks kept by a worker; beyond it the store starts anew, which costs time but changes nothing.
KEPT_CHUNKS = 400_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes → rank, of a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    return parse_ranks(Path(path).read_bytes())


class PairIndex:
    """Merges many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_rank: dict[int, int] = {}

    def _rank(self, key: int) -> int:
        rank = self.pair_rank.get(key)
        if rank is None:
            rank = self.ranks.get(self.token[key >> 20] + self.token[key & 0xFFFFF], -1)
            self.pair_rank[key] = rank
        return rank

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        joined = b"".join(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        begins = (ends - sizes).tolist()
        n = len(joined)
        if not n:
            return [[] for _ in words]
        symbols = self.of_byte[np.frombuffer(joined, np.uint8)]
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        first = np.roll(last, 1)
        symbol: list[int] = symbols.tolist()
        right: list[int] = np.where(last, -1, np.arange(1, n + 1)).tolist()
        left: list[int] = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        pair_rank, find = self.pair_rank, self._rank
        # the index: every pair that the vocabulary merges, with all its positions in ascending order
        at = np.flatnonzero(~last)
        pairs = symbols[at] << 20 | symbols[np.minimum(at + 1, n - 1)]
        order = np.argsort(pairs, kind="stable")
        keys, starts = np.unique(pairs[order], return_index=True)
        cuts = [*starts.tolist(), len(order)]
        at = at[order].tolist()
        places: dict[int, list[int]] = {}
        active = []
        for x, key in enumerate(keys.tolist()):
            rank = pair_rank.get(key)
            if rank is None:
                rank = find(key)
            if rank >= 0:
                places[key] = at[cuts[x] : cuts[x + 1]]
                active.append((rank, key))
        heapq.heapify(active)
        get, push = places.get, heapq.heappush
        while active:
            rank, key = heapq.heappop(active)
            one, two = key >> 20, key & 0xFFFFF
            high = rank << 20
            held = places.pop(key, ())
            if len(held) > 1:
                held.sort()
            for i in held:
                if symbol[i] != one:
                    continue
                j = right[i]
                if j < 0 or symbol[j] != two:
                    continue
                symbol[i], symbol[j] = rank, -1
                k = right[i] = right[j]
                if k >= 0:
                    left[k] = i
                    pair = high | symbol[k]
                    known = get(pair)
                    if known is not None:
                        known.append(i)
                    else:
                        r = pair_rank.get(pair)
                        if r is None:
                            r = find(pair)
                        if r >= 0:
                            places[pair] = [i]
                            push(active, (r, pair))
                k = left[i]
                if k >= 0:
                    pair = symbol[k] << 20 | rank
                    known = get(pair)
                    if known is not None:
                        known.append(k)
                    else:
                        r = pair_rank.get(pair)
                        if r is None:
                            r = find(pair)
                        if r >= 0:
                            places[pair] = [k]
                            push(active, (r, pair))
        out = []
        for word, i in zip(words, begins):
            ids = []
            if word:
                while i >= 0:
                    ids.append(symbol[i])
                    i = right[i]
            out.append(ids)
        return out


class _Chunks(dict):
    """Chunk → number; a chunk not met before gets the next number and waits."""

    def __init__(self, owner: "Encoder", lead: str) -> None:
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, chunk: str) -> int:
        owner = self.owner
        number = self[chunk] = owner.count
        owner.count += 1
        owner.waiting.append(self.lead + chunk.replace(_INNER, " "))
        return number


class Encoder:
    """Texts to ids, with the chunks met so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.index = PairIndex(ranks)
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.waiting: list[str] = []
        self.spaced, self.plain = _Chunks(self, " "), _Chunks(self, "")
        self.words: dict[str, list[int]] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.done = self.used = 0

    def begin(self) -> None:
        """To be called between batches: keeps the store within its bound."""
        if self.count > KEPT_CHUNKS:
            self._clear()

    def chunks(self, text: str) -> np.ndarray:
        """The numbers of the chunks of text. A pretoken never goes over a space that a visible character follows."""
        if not text:
            return np.zeros(0, np.int64)
        if not text.isascii() or "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " " or not text.isprintable():
            text = _LOOSE_SPACE.sub(_INNER, text)
        head, *rest = text.split(" ")
        numbers = np.empty(len(rest) + 1, np.int64)
        numbers[0] = self.plain[head]
        numbers[1:] = list(map(self.spaced.__getitem__, rest))
        return numbers

    def numbers(self, pretokens: list[str]) -> np.ndarray:
        return np.array(list(map(self.plain.__getitem__, pretokens)), np.int64)

    def settle(self) -> None:
        """Encode the chunks that wait."""
        if not self.waiting:
            return
        parts = [PRETOKEN.findall(chunk) for chunk in self.waiting]
        fresh = list(dict.fromkeys(w for words in parts for w in words if w not in self.words))
        self.words.update(zip(fresh, self.index.merge([w.encode() for w in fresh])))
        ids = [[i for w in words for i in self.words[w]] for words in parts]
        new = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
        lengths = np.array([len(x) for x in ids], np.int64)
        while self.count > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.length[self.done : self.count] = lengths
        self.start[self.done : self.count] = self.used + np.cumsum(lengths) - lengths
        self.done, self.used, self.waiting = self.count, self.used + len(new), []

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the chunks, one after the other."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - ends + lengths, lengths) + np.arange(total)]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; a null or empty text has none."""
        self.begin()
        each = [self.chunks(t or "") for t in texts]
        self.settle()
        per_text = np.array([int(self.length[n].sum()) for n in each], np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        return offsets, self.gather(np.concatenate(each)) if each else np.zeros(0, np.int32)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        self.begin()
        each = [self.chunks(t or "") for t in texts]
        self.settle()
        return np.array([int(self.length[n].sum()) for n in each], np.int64)


_ENCODERS: dict[bytes, Encoder] = {}
_SHIPPED: dict[tuple[str, str], Broadcast] = {}


def shipped(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file's bytes, read on the driver and broadcast once in an application; executors need no copy of the file."""
    key = (spark.sparkContext.applicationId, os.path.abspath(path))
    if key not in _SHIPPED:
        _SHIPPED[key] = spark.sparkContext.broadcast(Path(path).read_bytes())
    return _SHIPPED[key]


def encoder(vocabulary: str | bytes = VOCABULARY) -> Encoder:
    """This process's encoder for a vocabulary file's path or bytes."""
    lines = vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()
    key = hashlib.sha256(lines).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(lines))
    return _ENCODERS[key]
