"""Byte-level BPE encoding and decoding with the tiktoken library.

Long texts are split before the encoder sees them, at places that are match
boundaries of the pre-splitting pattern whatever surrounds them: a space or
line feed right after an ASCII letter or digit always begins a new match, and
what stands before it ends in a non-space, so no look-ahead changes.  That holds
for ``SPLIT_AT_SPACES``; texts are encoded in one piece under any other pattern.
Decoding joins the ranks' raw bytes and never goes through a string.

Edge cases.  A null text counts as empty and has no ids; repeated rows stay; a
text without any safe boundary is encoded in one piece; ids not in the rank
file fail.  Other columns pass through ``encode`` and ``decode`` unchanged,
except one that has the output's name, which is replaced.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Characters from which a text is split, and how many go in each part at least.
LONG = 1 << 16

#: Fixed value: the pre-splitting pattern whose matches begin at such places.
SPLIT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoder of a local rank file, without special tokens (kept per worker)."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG):
    """``text`` in parts whose encodings join to its encoding."""
    start = 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoder, text: str) -> list[int]:
    if len(text) <= LONG or encoder._pat_str != SPLIT_AT_SPACES:
        return encoder.encode_ordinary(text)
    return [i for part in parts(text) for i in encoder.encode_ordinary(part)]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [f for f in batch.schema.names if f != name]
    return pa.RecordBatch.from_arrays([*(batch.column(f) for f in kept), column], [*kept, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of the whole text."""

    def run(batches):
        encoder = encoding(ranks_path, pattern)
        for batch in slices(batches):
            rows = [encode_text(encoder, x or "") for x in batch.column(text).to_pylist()]
            yield _with(batch, ids, pa.array(rows, pa.list_(pa.int32())))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Add ``data``, the raw bytes of ``ids``."""

    def run(batches):
        encoder = encoding(ranks_path, pattern)
        for batch in slices(batches):
            rows = [encoder.decode_bytes(x or []) for x in batch.column(ids).to_pylist()]
            yield _with(batch, data, pa.array(rows, pa.binary()))

    return df.mapInArrow(run, _schema(df, data, T.BinaryType()))
