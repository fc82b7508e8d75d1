"""Offsets, dense groups, string pools and sparse levels, without one task for all rows.

A running sum over all rows would put them in one partition; here rows are range-partitioned by the order, each range is summed by its
own task, and only the sums of the ranges (one row each) are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before, in the order of columns `order`, which must be unique together."""
    keys = [F.col(c) for c in order]
    part = df.withColumn("__v", value).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    part = fixed(part)
    sums = part.groupBy("__p").agg(F.sum("__v").alias("__s"))  # one row for each range
    before = sums.withColumn("__b", F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__b", F.lit(0)).alias("__b"))
    w = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return part.join(F.broadcast(before), "__p").withColumn(name, F.coalesce(F.sum("__v").over(w), F.lit(0)) + F.col("__b")).drop("__v", "__p", "__b")


def fixed(df: DataFrame) -> DataFrame:
    """Keep partition numbers as they are now: ranges come from samples and could differ when computed again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def sort_alphabetical(df: DataFrame, column: str) -> DataFrame:
    """Rows in byte order of a string, a total order over all partitions."""
    return df.orderBy(column)


def sort_numeric(df: DataFrame, column: str) -> DataFrame:
    """Rows by the number at the start of a string; those without one count as 0, ties by the string."""
    number = F.regexp_extract(column, r"^\s*([-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    return df.orderBy(F.coalesce(number, F.lit(0.0)), column)


def group_offsets(rows: DataFrame, key: str, last: int | None = None, most: int = 65_535) -> DataFrame:
    """key, start_index and n for every key from 1 to the last, empty ones too; a group of over `most` rows is an error."""
    n = F.count(F.lit(1))
    per = rows.groupBy(key).agg(F.when(n <= most, n).otherwise(F.raise_error(F.lit(f"over {most} rows in a group")).cast("long")).alias("n"))
    spark = rows.sparkSession
    last = last if last is not None else per.agg(F.max(key)).first()[0] or 0
    dense = spark.range(1, last + 1).withColumnRenamed("id", key).join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return running_sum(dense, [key], F.col("n"), "start_index")


def string_pool(strings: DataFrame, text: str) -> DataFrame:
    """Distinct strings, their byte lengths and offsets in a pool of terminated strings that starts with an empty one."""
    pool = strings.where(F.col(text) != "").select(text).distinct()
    return running_sum(pool, [text], F.octet_length(text) + 1, "pool_offset").withColumn("pool_offset", F.col("pool_offset") + 1)


def sparse_level(rows: DataFrame, order: list[str], every: int) -> DataFrame:
    """Every so-many-th row with its number, the first one at 0."""
    return running_sum(rows, order, F.lit(1).cast("long"), "row_no").where(F.col("row_no") % every == 0)


def byte_sample(df: DataFrame, size: str, order: list[str], budget: int, seed: int = 42) -> DataFrame:
    """Rows by a seeded hash of `order` until their sizes reach the budget; the same rows whenever it runs."""
    h = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), *order).cast("binary")))
    return running_sum(h, ["__h", *order], F.col(size), "__before").where(F.col("__before") < budget).drop("__h", "__before")
