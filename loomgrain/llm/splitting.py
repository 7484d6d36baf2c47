"""Splitting of oversized texts at natural boundaries (problem 8).

The least number of pieces follows from the token count, the limit and the overlap. Equal-length
targets are placed, each is snapped to the strongest boundary near it, and the real token count of
each piece is taken. Where any piece is over the limit, the text is laid out again with one piece more.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import spread
from loomgrain.llm import bpe

LIMIT = 2048
OVERLAP = 128
#: Strengths of boundaries: an empty line, a line's end, a sentence's end, a word's end.
PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1
_BLANK = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|[\n\r  \x85]")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’)\]]*(?=\s)|[。！？｡]+[」』”’）]*)")
_WORD = re.compile(r"\s+")
#: What belongs to the character before it.
_JOINED = regex.compile(r"[\p{M}\p{Emoji_Modifier}\u200d]|(?<=\r)\n")


def boundaries(text: str) -> tuple[list[int], dict[int, int]]:
    """Places at which text may be cut, ascending, and each one's strength."""
    strength: dict[int, int] = {}
    for pattern, value in ((_WORD, WORD), (_SENTENCE, SENTENCE), (_LINE, LINE), (_BLANK, PARAGRAPH)):
        for m in pattern.finditer(text):
            # a cut between words leaves the space with the word after it, as the vocabulary does
            strength[m.start() if value == WORD else m.end()] = value
    strength.pop(0, None)
    strength.pop(len(text), None)
    return sorted(strength), strength


class Layout:
    """Positions of one text by tokens and characters."""

    def __init__(self, text: str, enc: bpe.Encoder) -> None:
        self.text, self.enc = text, enc
        pretokens = bpe.PRETOKEN.findall(text)
        numbers = enc.numbers(pretokens)
        enc.settle()
        sizes = enc.length[numbers]
        chars = np.array([len(p) for p in pretokens], np.int64)
        self.char_ends = np.concatenate([[0], np.cumsum(chars)])
        self.token_ends = np.concatenate([[0], np.cumsum(sizes)])
        self.total = int(self.token_ends[-1])
        self.places, self.strength = boundaries(text)

    def char_at(self, tokens: float) -> int:
        """The character at about so many tokens; inside a long pretoken in proportion."""
        return int(np.interp(tokens, self.token_ends, self.char_ends))

    def token_at(self, char: int) -> float:
        return float(np.interp(char, self.char_ends, self.token_ends))

    def between_characters(self, at: int, low: int) -> int:
        """The nearest place at or before `at`, not before low, that parts no visible character from its marks."""
        place = at
        while place > low and self.parts_marks(place):
            place -= 1
        return at if self.parts_marks(place) else place

    def parts_marks(self, at: int) -> bool:
        """Whether a cut there parts a visible character from its marks."""
        return bool(_JOINED.match(self.text, at)) or self.text[at - 1 : at] == "\u200d"

    def snap(self, target: int, low: int, high: int, least: int | None = None) -> int:
        """The strongest boundary in [low, high], of equal ones the nearest to target; if there is none the place between characters at target or before it, down to least."""
        near = self.places[bisect.bisect_left(self.places, low) : bisect.bisect_right(self.places, high)]
        if not near:
            return self.between_characters(min(max(target, low), high), low if least is None else least)
        return min(near, key=lambda p: (-self.strength[p], abs(p - target), p))

    def last_resort(self, before: int, start: int, overlap: int, low: int, high: int) -> int | None:
        """Where [low, high] has no boundary: the strongest one before it, of equal ones the last, behind the last piece's end and the repeated part."""
        first = bisect.bisect_left(self.places, low)
        if bisect.bisect_right(self.places, min(high, len(self.text) - 1)) > first:
            return None
        least = max(before, self.char_at(self.token_at(start) + overlap))
        return max(self.places[bisect.bisect_right(self.places, least) : first], key=lambda p: (self.strength[p], p), default=None)

    def cut(self, pieces: int, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, end's strength, characters repeated) of each piece."""
        out = []
        start, repeated, end = 0, 0, 0
        laid, done, core = float(overlap), 0, (self.total - overlap) / pieces
        for k in range(1, pieces + 1):
            before = end
            if k == pieces:
                end, kind = len(self.text), PARAGRAPH
            else:
                target = laid + core * (k - done)
                first = self.token_at(start)
                slack = min(core / 2, max(0.0, first + limit - 2 - target))
                low = max(self.char_at(target - min(core / 2, max(slack, core / 4))), before + 1)
                high = max(low, self.char_at(target + slack))
                last = self.last_resort(before, start, overlap, low, high)
                if last is None:
                    end = self.snap(max(low, min(self.char_at(target), high)), low, min(high, len(self.text) - 1), before + 1)
                else:
                    # the rest is laid out anew from there
                    end = last
                    laid, done = self.token_at(end), k
                    core = (self.total - laid) / (pieces - k)
                kind = self.strength.get(end, 0)
            out.append((start, end, kind, repeated))
            tokens = self.token_at(end) - overlap
            low, high = self.char_at(tokens - overlap / 4), self.char_at(tokens + overlap / 4)
            low = max(low, start + 1)
            start = self.snap(max(low, self.char_at(tokens)), low, max(low, min(high, end - 1))) if overlap else end
            start = min(start, end)
            while start < end and self.parts_marks(start):
                start += 1  # no place before it near enough: less is repeated
            repeated = end - start
        return out


def split_text(text: str, enc: bpe.Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(start, end, tokens, boundary strength, repeated characters) of each piece of text.

    A text within the limit is one piece. Every character is in a piece, pieces follow each other in
    order, each is at most `limit` tokens when encoded by itself. A text without any boundary, such as
    one very long word, is cut between characters.
    """
    layout = Layout(text, enc)
    if layout.total <= limit:
        return [(0, len(text), layout.total, PARAGRAPH, 0)]
    pieces = max(2, -(-(layout.total - overlap) // (limit - overlap)))
    while True:
        cuts = layout.cut(pieces, limit, overlap)
        spans = [text[a:b] for a, b, _, _ in cuts]
        numbers = [enc.chunks(s) for s in spans]
        enc.settle()
        sizes = [int(enc.length[n].sum()) for n in numbers]
        if max(sizes) <= limit:
            return [(a, b, n, kind, again) for (a, b, kind, again), n in zip(cuts, sizes)]
        pieces += 1


def split_oversized(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    vocabulary: str = bpe.VOCABULARY,
) -> DataFrame:
    """Pieces of each text of more than `limit` tokens.

    Columns: id_column, piece_no (from 0), n_pieces, doc_tokens, start_char, end_char, n_tokens,
    boundary (4 empty line or end of text, 3 line, 2 sentence, 1 word, 0 none), overlap_chars, piece.
    Null, empty and smaller texts give no rows. A text of no more bytes than `limit` can't have more
    tokens and isn't sent to Python; every other text is counted whole. One pass; equal
    rows give equal pieces, once for each row.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("overlap must be less than a quarter of limit")
    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "piece_no", "n_pieces", "doc_tokens", "start_char", "end_char", "n_tokens", "boundary", "overlap_chars", "piece"]

    shared = bpe.shipped(df.sparkSession, vocabulary)

    def run(batches):
        enc = bpe.encoder(shared.value)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                enc.begin()
                numbers = enc.chunks(text)
                enc.settle()
                total = int(enc.length[numbers].sum())
                if total <= limit:
                    continue
                pieces = split_text(text, enc, limit, overlap)
                for k, (a, b, n, strength, again) in enumerate(pieces):
                    ids.append(i)
                    rows.append((k, len(pieces), total, a, b, n, strength, again, text[a:b]))
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=names)

    text = F.col(text_column).cast("string")
    schema = f"`{id_column}` {kind}, piece_no int, n_pieces int, doc_tokens bigint, start_char bigint, end_char bigint, n_tokens int, boundary int, overlap_chars bigint, piece string"
    return spread(df.select(F.col(id_column), text.alias("__text")).filter(F.octet_length("__text") > limit)).mapInArrow(run, schema)
