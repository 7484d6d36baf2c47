"""Encoding of a whole corpus (problem 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import spread
from loomgrain.llm import bpe

#: Characters that are taken together before their new chunks are merged.
BATCH_CHARS = 8_000_000


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """id_column and ids array<int>: each text's ids, without special tokens.

    One pass; every row is kept, repeated ids included. A null and an empty text
    give an empty list. Text that looks like a special token is ordinary text. A text of any length
    is encoded whole.
    """
    kind = df.schema[id_column].dataType

    shared = bpe.shipped(df.sparkSession, vocabulary)

    def run(batches):
        enc = bpe.encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < BATCH_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                offsets, ids = enc.encode_many(texts[at:end])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists], names=[id_column, "ids"])
                at = end

    return spread(df.select(F.col(id_column), F.col(text_column).cast("string"))).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, ids array<int>")
