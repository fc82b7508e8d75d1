"""Links of pages: extraction, and lookup of titles with a second key, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .offsets import fixed

HREF = r'href="([^"]*)"'


def extract_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, link_no, href and kind (fragment, external or internal) of each link; pages without links give no rows."""
    found = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("link_no", "href"))
    return found.withColumn("kind", T.classify_link(F.col("href")))


def sitelink_table(sitelinks: DataFrame) -> DataFrame:
    """lang, title and qid with one row a key; of several qids of one title the least counts."""
    return sitelinks.groupBy("lang", "title").agg(F.min("qid").alias("qid"))


def lookup(rows: DataFrame, sitelinks: DataFrame, lang: Column, title: Column, url: Column) -> DataFrame:
    """rows with the qid of their first key, else of their second; null where neither is known.

    sitelinks has lang, title and qid; of several qids of one title the least counts. Both joins are left equi-joins, so Catalyst
    broadcasts a small side and sorts large ones.
    """
    own = sitelink_table(sitelinks)
    keyed = rows.withColumn("__lang", lang).withColumn("__k1", T.title_key(title, url)).withColumn("__k2", T.fallback_key(url))
    for i in "12":
        side = own.select(F.col("lang").alias("__lang"), F.col("title").alias(f"__k{i}"), F.col("qid").alias(f"__q{i}"))
        keyed = keyed.join(side, ["__lang", f"__k{i}"], "left")
    return keyed.select(*rows.columns, F.coalesce("__q1", "__q2").alias("qid"))


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start and end of the unions of overlapping or touching intervals of each key.

    Rows are range-partitioned by key and start, so a key with very many intervals is many tasks; what a task has to know of those before
    it in the same key is one row for each partition that the key spans.
    """
    part = fixed(rows.select(key, start, end).repartitionByRange(key, start, end).withColumn("__p", F.spark_partition_id()))
    own = Window.partitionBy("__p", key).orderBy(start, end)

    def carried(df: DataFrame, value: str, name: str) -> DataFrame:
        """The greatest value of the key in the partitions before."""
        per = df.groupBy(key, "__p").agg(F.max(value).alias("__v"))
        across = per.join(per.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), key, "left_semi")
        before = across.select(key, "__p", F.max("__v").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias(name))
        return df.join(before, [key, "__p"], "left")

    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    known = carried(part.withColumn("__reach", reach), end, "__far")
    so_far = F.greatest("__reach", "__far")
    opened = known.withColumn("__open", F.when(so_far.isNull() | (F.col(start) > so_far), F.col(start)))
    at = F.max("__open").over(own.rowsBetween(Window.unboundedPreceding, 0))
    islands = carried(opened.select(key, start, end, "__p", "__open", at.alias("__at")), "__open", "__since")
    return islands.groupBy(key, F.coalesce("__at", "__since").alias("__island")).agg(F.max(end).alias(end)).select(key, F.col("__island").alias(start), end)


def collapse_blank(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines without the blank ones that follow a blank one."""
    blank = F.trim(line) == ""
    before = F.lag(blank).over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("__drop", blank & F.coalesce(before, F.lit(False))).where(~F.col("__drop")).drop("__drop")
