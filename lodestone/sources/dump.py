"""Text sources: entity dumps, delimited relations, dead letters, listings and folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ANOMALY = "qid string, lang string, title string, error_msg string, raw_content string"


def dump_lines(spark: SparkSession, path: str, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """Lines of a dump, one entity each; gzip is one partition a file, so lines are dealt out right after they are read."""
    lines = spark.read.text(path)
    if limit is not None:
        lines = lines.limit(limit)
    return lines.repartition(partitions) if partitions else lines


def delimited(spark: SparkSession, path: str, columns: str, delimiter: str = "\t") -> DataFrame:
    """A relation without header; rows whose number of fields isn't that of `columns` (a DDL string) are dropped, fields that don't parse are null."""
    fields = StructType.fromDDL(columns).fields
    parts = F.split("value", "\\Q" + delimiter + "\\E", -1)
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(fields))
    return rows.select(*[F.col("p")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def anomalies(spark: SparkSession, path: str) -> DataFrame:
    """Dead letters as they were written; broken lines are dropped."""
    return spark.read.schema(ANOMALY).option("mode", "DROPMALFORMED").json(path)


def listed_files(pages: DataFrame, html: Column, pattern: str) -> DataFrame:
    """lang and href of the links of listing pages that match a pattern with one group, the language."""
    hrefs = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.where(F.col("href").rlike(pattern)).select(F.regexp_extract("href", pattern, 1).alias("lang"), "href")


def latest_files(listed: DataFrame) -> DataFrame:
    """lang and its greatest href, which is the latest."""
    return listed.groupBy("lang").agg(F.max("href").alias("href"))


def not_available(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Requested rows that have no match."""
    return requested.join(available.select(key).distinct(), key, "left_anti")


def discover(spark: SparkSession, path: str, pattern: str, languages: list[str], completed: DataFrame | None = None) -> DataFrame:
    """path, lang and size of the files below a folder whose name matches a pattern with one group, the language; smallest first, without completed paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    found = found.where(name.rlike(pattern)).select("path", F.regexp_extract(name, pattern, 1).alias("lang"), "size").where(F.col("lang").isin(*languages))
    if completed is not None:
        found = found.join(completed.select("path"), "path", "left_anti")
    return found.orderBy("size", "path")
