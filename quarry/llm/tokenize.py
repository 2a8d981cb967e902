"""p6: ids of every text by a public byte-level tokenizer."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.runtime import spread
from quarry.llm import bpe

_encoders: dict[str, bpe.PrefixEncoder] = {}


def encoder_for(blob: bytes) -> bpe.PrefixEncoder:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = bpe.PrefixEncoder(bpe.read_ranks(blob))
    return _encoders[key]


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id_col, ids array<int>), one row for each row of df, in one pass without a shuffle.

    vocabulary: path of a rank file (base64 token and rank on each line); it is read on the driver and
    broadcast, its size is that of the vocabulary whatever the corpus. Null and empty texts give an empty
    list, blank texts are encoded like any other, special tokens' strings are ordinary text. Repeated ids
    give repeated rows, null ids are kept, other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = spread(df.select(id_col, text_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_for(shared.value)
        for b in batches:
            offsets, ids = encoder.encode_batch(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
