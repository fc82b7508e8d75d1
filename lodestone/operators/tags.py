"""Tags: bit masks, filters, and the closure of a class hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TAGS = 32


def filter_tags(df: DataFrame, include: int = 0, exclude: int = 0, tags: str = "tags") -> DataFrame:
    """Rows that have all bits of include and none of exclude; 0 asks for nothing."""
    if include:
        df = df.where(F.col(tags).bitwiseAND(F.lit(include)) == include)
    if exclude:
        df = df.where(F.col(tags).bitwiseAND(F.lit(exclude)) == 0)
    return df


def bit(position: Column) -> Column:
    """1 shifted by a position; over 31 is an error."""
    return F.when(position < MOST_TAGS, F.call_function("shiftleft", F.lit(1).cast("long"), position)).otherwise(F.raise_error(F.lit("over 32 tags")).cast("long"))


def tag_mask(rows: DataFrame, key: str, position: str) -> DataFrame:
    """key and the OR of its tags' bits, combined before the shuffle."""
    return rows.groupBy(key).agg(F.bit_or(bit(F.col(position).cast("int"))).alias("tags"))


def subclass_closure(edges: DataFrame, tags: DataFrame, write=None) -> DataFrame:
    """child and tag: every class that reaches a tag by (child, parent) edges, tags themselves included; cycles are fine.

    Frontier joins to the fix-point; each round only what is new is joined, and `write` (checkpoint by default) cuts lineage.
    """
    write = write or (lambda df: df.checkpoint())
    known = write(tags.select(F.col("tag").alias("child"), "tag").distinct())
    frontier = known
    while True:
        new = frontier.join(edges.withColumnRenamed("child", "below"), F.col("child") == F.col("parent")).select(F.col("below").alias("child"), "tag").distinct()
        frontier = write(new.join(known, ["child", "tag"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = write(known.union(frontier))


def tag_entities(entity_classes: DataFrame, closure: DataFrame) -> DataFrame:
    """qid and its distinct tags in order, from qid and class_qid."""
    return entity_classes.join(closure, F.col("class_qid") == F.col("child")).groupBy("qid").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def usage(rows: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys, ties by key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(key)).limit(n)


def distinct_by(rows: DataFrame, keys: list[str], counted: str, name: str = "n") -> DataFrame:
    """keys and their number of distinct values of a column."""
    return rows.groupBy(*keys).agg(F.countDistinct(counted).alias(name))


def latest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, its greatest value and its number of rows."""
    return rows.groupBy(key).agg(F.max(value).alias("latest"), F.count(F.lit(1)).alias("n"))
