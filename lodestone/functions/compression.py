"""Frames of zstandard with a shared dictionary, over Arrow batches, and their statistics."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

DICTIONARY_BYTES, LEVEL, WINDOW_LOG = 32_768, 3, 15
#: Bytes of the raw length before each frame.
PREFIX = 4
#: Bytes of text that a dictionary is trained on: a bound of what reaches the driver.
SAMPLE_BYTES = 5_000_000
#: Bytes of a column that are Python objects at once, or one value's.
PIECE_BYTES = 1_000_000


def train_dictionary(texts: DataFrame, body: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of a sample, which must be bounded (offsets.byte_sample); empty where the sample is too small for one."""
    samples = [r[0].encode() for r in texts.select(body).where(F.length(body) > 0).toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold PIECE_BYTES of a column or so."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, past + PIECE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _release() -> None:
    """Give back what this process doesn't use: idle workers stay with their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def _map(df: DataFrame, column: str, name: str, kind: pa.DataType, make) -> DataFrame:
    """df with a column made from another, in Arrow batches, a piece at a time; all others pass untouched."""
    schema = to_arrow_schema(df.schema).append(pa.field(name, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        try:
            for batch in batches:
                for b in _pieces(batch, column):
                    made = pa.array([None if x is None else one(x) for x in b.column(column).to_pylist()], kind)
                    yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)
        finally:
            _release()

    return df.mapInArrow(run, from_arrow_schema(schema))


def compress(df: DataFrame, body: str, name: str, dictionary: bytes = b"", level: int = LEVEL, window_log: int = WINDOW_LOG) -> DataFrame:
    """df with `name`: the raw length (four bytes, little-endian) and one frame of a string column's UTF-8; null stays null."""

    def make():
        given = zstandard.ZstdCompressionParameters.from_level(level, window_log=window_log)
        c = zstandard.ZstdCompressor(dict_data=_dictionary(dictionary), compression_params=given)

        def one(text: str) -> bytes:
            raw = text.encode()
            return len(raw).to_bytes(PREFIX, "little") + c.compress(raw)

        return one

    return _map(df, body, name, pa.binary(), make)


def decompress(df: DataFrame, packed: str, name: str, dictionary: bytes = b"") -> DataFrame:
    """df with `name`, the text of compress(); a frame that doesn't give its stated length raises."""

    def make():
        d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

        def one(blob: bytes) -> str:
            n = int.from_bytes(blob[:PREFIX], "little")
            raw = d.decompress(blob[PREFIX:], max_output_size=max(n, 1)) if n else b""
            if len(raw) != n:
                raise ValueError(f"{len(raw)} bytes where {n} were stated")
            return raw.decode()

        return one

    return _map(df, packed, name, pa.string(), make)


def ratio_report(df: DataFrame, raw: Column, packed: Column, *keys: str) -> DataFrame:
    """Count, sums, the ratio of the sums, and mean, population deviation, least and greatest ratio of the rows, by keys; rows of raw length 0 have no ratio."""
    ratio = F.when(raw > 0, packed / raw)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(raw).alias("raw_bytes"), F.sum(packed).alias("packed_bytes"), F.round(F.sum(packed) / F.sum(raw), 6).alias("bulk_ratio"),
        F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.stddev_pop(ratio), 6).alias("deviation"), F.round(F.min(ratio), 6).alias("least"), F.round(F.max(ratio), 6).alias("most"),
    )
