"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """materialize() in buckets of a column, as many as shuffles have partitions: what groups or joins by that column reads df where it lies, without a shuffle."""
    spark = df.sparkSession
    own = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    place = f"spark_catalog.default.{own}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{own}").bucketBy(buckets, by).sortBy(by).saveAsTable(place, format="parquet")
    found = spark.table(place)
    spark.sql(f"DROP TABLE {place}")  # only its name: the files stay, as those of materialize()
    return found


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_buckets(spark: SparkSession, rows: int, rows_each: int, factor: int = 4) -> int:
    """Buckets for `rows` rows: enough that none holds much over rows_each, and a few for each shuffle partition."""
    return max(factor * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; remainder 2 is held out. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4


HELD_OUT = 2


#: What workers keep between tasks for speed: functions that empty it.
FORGET: list[Callable[[], None]] = []


def release() -> None:
    """Give back what this process doesn't use: idle Python workers stay with their executor, and what they hold counts there in every later stage."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, that gives the worker's memory back at the end."""

    def apply(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return apply


def slices(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, or as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, run: Callable[[dict[str, list]], dict], given: list[str], added: str, rows: int | None = None, within: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """df without the columns in `given`, with those in `added`, which run() makes from the given ones of a batch (`rows` at once at most) as Python lists.

    All other columns, ids among them, pass as they are, in Arrow: no long becomes a double because a null stands beside it. `within` names the struct
    and the place in it where a given column stands that df has not by itself.
    """
    new = _parse_datatype_string(added)
    kept = [f for f in df.schema.fields if f.name not in given]
    schema = StructType(kept + new.fields)
    types = [f.type for f in to_arrow_schema(new)]
    names = [f.name for f in kept]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = run({c: (pc.struct_field(batch.column(within[c][0]), within[c][1]) if within else batch.column(c)).to_pylist() for c in given})
            made = [pa.array(out[f.name], t) for f, t in zip(new.fields, types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + made, [f.name for f in schema.fields])

    return df.mapInArrow(releasing(apply), schema)


#: Bits of a filter at most: a bounded broadcast of 32 MB. What passes by chance only costs work.
MOST_BITS = 1 << 28


def bit_filter(values: DataFrame, col: str) -> np.ndarray:
    """Which residues, modulo a power of two of at least sixteen times their number (MOST_BITS at most), the values of a long column have. values should be materialized."""
    bits = 1 << 16
    n = values.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.pmod(F.col(col), F.lit(bits))
    found = values.where(F.col(col).isNotNull()).select((at / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({col}, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be among those of the filter."""
    at = values & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1
