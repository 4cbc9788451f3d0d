"""Encoding of whole corpora with a public tokenizer, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.bpe import Decoder, Encoder, Vocabulary, tokenizer_file

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Texts encoded at a time, which bounds a worker's memory.
SLICE = 256

_workers: dict[int, Any] = {}


def _once(shared: Broadcast, kind: type) -> Any:
    """One encoder or decoder for each worker process and vocabulary; it outlives the task."""
    key = (id(kind), shared.value.__class__, hash(shared.value.pattern), len(shared.value.tokens), hash(tuple(shared.value.tokens[-50:])))
    if key not in _workers:
        if len(_workers) >= 3:
            _workers.clear()
        _workers[key] = kind(shared.value)
    return _workers[key]


def _share(df: DataFrame, tokenizer: str, folder: str | None) -> Broadcast:
    """The vocabulary for all executors: a table of fixed size, a few MB."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(tokenizer_file(tokenizer, folder)))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, without special tokens.

    Null, empty texts give an empty array; blank texts are encoded as they are; strings that
    look like special tokens are ordinary text. Bytes that aren't UTF-8 are encoded as
    replacement characters. Rows stay where they are: no shuffle, one row out for each row in,
    repeated or not. Texts are never cut. Other columns are ignored.
    """
    shared = _share(df, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(shared, Encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                done = [encoder.encode_bytes(t) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in done])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(done), dtype=np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.make_valid_utf8(F.col(text_col)).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of every row; null ids give a null text, no ids an empty one.

    An id outside the vocabulary, or a null among the ids, is an error.
    """
    shared = _share(df, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(shared, Decoder)
        for batch in batches:
            texts = [decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).alias("__ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def count_tokens(df: DataFrame, keep: list[str], text_col: str, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (0 for null and empty texts) of every row."""
    shared = _share(df, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(shared, Encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes = [encoder.count(t) for t in part.column(0).to_pylist()]
                yield pa.record_batch([*part.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.make_valid_utf8(F.col(text_col)).alias("__text"), *keep).mapInArrow(run, f"{kinds}, n_tokens bigint")
