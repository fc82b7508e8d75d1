"""The query surface: six searches over range-sorted tables, as lazy DataFrames.

A Database holds up to seven tables: omni_terms (term, qid, tags), temporal_terms (date_code, qid, pid, tags), globe_terms and astro_terms
(morton, lat, lon, qid, tags), entity_payloads (qid, project_id, title, data_offset, data_length), properties (pid,
project_id, label, description) and content (qid, project_id, body). Every search returns id, tags, article_type,
title, term, data_offset and data_length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo
from . import tags

#: Results of a distance-ordered search at most; 0 asks for as many.
MOST_SORTED = 50
RESULT = ("id", "tags", "article_type", "title", "term", "data_offset", "data_length")
TABLES = ("omni_terms", "temporal_terms", "globe_terms", "astro_terms", "entity_payloads", "properties", "content")


@dataclass(frozen=True)
class SearchQuery:
    """What to search: kind is 'text', 'date', 'globe', 'astro', 'qid' or 'pid'; article_type is a project id, or None for metadata (0)."""

    kind: str
    article_type: int = 1
    include_tags: int = 0
    exclude_tags: int = 0
    text: str = ""
    case_sensitive: bool = False
    date: int = 0
    backward: bool = False
    lat: float = 0.0
    lon: float = 0.0
    radius: float = 0.0
    sort_by_distance: bool = False
    max_results: int = 0
    target_id: int = 0
    must_match: bool = False
    limit: int | None = None
    max_ranges: int = 16
    #: Top-k as it was first built: tags don't filter, and k are picked before the article type is known.
    strict_reference: bool = False


def first_per_entity(hits: DataFrame, *order: Column) -> DataFrame:
    """The first hit of each qid in scan order: exact, and one shuffle by qid (a hot qid is pre-aggregated by min of a struct)."""
    keys = [f"__o{i}" for i in range(len(order))]
    cols = [c for c in hits.columns if c != "qid"]
    packed = F.struct(*[o.alias(k) for k, o in zip(keys, order)], *[F.col(c) for c in cols])
    return hits.groupBy("qid").agg(F.min(packed).alias("__r")).select("qid", *[F.col(f"__r.{c}").alias(c) for c in cols])


def resolve(hits: DataFrame, payloads: DataFrame, article_type: int) -> DataFrame:
    """Inner join of hits (one a qid) with their first payload of an article type; hits without one are out.

    Hits come first: few of them are broadcast to the scan of payloads, and only payloads of theirs are put in order.
    """
    cols = [c for c in hits.columns if c != "qid"]
    own = payloads.where(F.col("project_id") == article_type).select("qid", F.struct("data_offset", "data_length", "title").alias("__p"))
    both = hits.select("qid", F.struct(*cols).alias("__h")).join(own, "qid").groupBy("qid").agg(F.first("__h").alias("__h"), F.min("__p").alias("__p"))
    kept = [F.col(f"__h.{c}").alias(c) for c in cols if c.startswith("__")]
    return both.select(F.col("qid").alias("id"), "__h.tags", F.lit(article_type).cast("smallint").alias("article_type"), F.coalesce("__p.title", F.lit("")).alias("title"), "__h.term", "__p.data_offset", "__p.data_length", *kept)


def text_search(terms: DataFrame, payloads: DataFrame, q: SearchQuery) -> DataFrame:
    text = (q.text if q.case_sensitive else q.text.lower()).encode()[:55].decode("utf-8", "ignore")
    hits = tags.filter_tags(terms.where(F.col("term").startswith(text)), q.include_tags, q.exclude_tags).select("term", "qid", "tags")
    return resolve(first_per_entity(hits.withColumn("__key", F.col("term")), F.col("term")), payloads, q.article_type).orderBy("__key", "id").drop("__key")


def date_search(terms: DataFrame, payloads: DataFrame, q: SearchQuery) -> DataFrame:
    code = F.col("date_code")
    hits = terms.where((code <= q.date) if q.backward else (code >= q.date)).where("qid > 0")
    hits = tags.filter_tags(hits, q.include_tags, q.exclude_tags).select("qid", "tags", code.alias("__key"), (-code if q.backward else code).alias("__scan"))
    hits = first_per_entity(hits, F.col("__scan")).withColumn("term", dates.format_date(F.col("__key")))
    return resolve(hits, payloads, q.article_type).orderBy("__scan", "id").drop("__key", "__scan")


def radius_search(terms: DataFrame, payloads: DataFrame, q: SearchQuery, sphere: geo.Sphere) -> DataFrame:
    """Morton ranges reach the scan as predicates; the chord decides. With sort_by_distance, the nearest position of each entity, nearest first."""
    hits = terms.where(geo.in_ranges(F.col("morton"), geo.radius_cover(q.lat, q.lon, q.radius, sphere, q.max_ranges)))
    hits = hits.withColumn("__dist", geo.chord_squared(F.col("lat"), F.col("lon"), q.lat, q.lon))
    if q.radius > 0:
        hits = hits.where(F.col("__dist") <= geo.radius_chord_squared(q.radius, sphere))
    else:
        centre = geo.encode(F.lit(q.lat), F.lit(q.lon), sphere)
        hits = hits.where(F.col("morton") == centre)
    if not (q.strict_reference and q.sort_by_distance):
        hits = tags.filter_tags(hits, q.include_tags, q.exclude_tags)
    hits = hits.withColumn("term", geo.format_position(F.col("lat"), F.col("lon"))).select("qid", "tags", "term", F.col("morton").alias("__morton"), "__dist")
    if not q.sort_by_distance:
        return resolve(first_per_entity(hits, F.col("__morton")), payloads, q.article_type).orderBy("__morton", "id").drop("__morton", "__dist")
    k = min(q.max_results, MOST_SORTED) or MOST_SORTED
    best = first_per_entity(hits, F.col("__dist"), F.col("__morton"))
    if q.strict_reference:
        best = best.orderBy("__dist", "__morton", "qid").limit(k)
    return resolve(best, payloads, q.article_type).orderBy("__dist", "__morton", "id").limit(k).drop("__morton", "__dist")


def page_ids(rows: DataFrame, key: str, q: SearchQuery) -> DataFrame:
    """Rows from the target id on, in direction.

    Where a match isn't required, a backward scan from beyond the last id starts at the last, and a forward scan from 0 at 1. An
    id of 0 or beyond the last otherwise gives nothing; a required match without a row for the article type gives nothing.
    """
    own = rows.where(F.col("project_id") == q.article_type)
    start = q.target_id
    if not q.must_match and not q.backward and start == 0:
        start = 1
    if start == 0:
        return own.where(F.lit(False))
    own = own.where(F.col(key) <= start) if q.backward else own.where(F.col(key) >= start)
    if not q.backward or q.must_match:  # snapping to the last id asks for the same rows
        own = own.where(F.lit(start) <= rows.agg(F.max(key)).scalar())
    if q.must_match:
        own = own.where(rows.where((F.col("project_id") == q.article_type) & (F.col(key) == start)).exists())
    return own.orderBy(F.col(key).desc() if q.backward else F.col(key).asc())


def id_search(payloads: DataFrame, q: SearchQuery) -> DataFrame:
    page = page_ids(payloads, "qid", q)
    return page.select(F.col("qid").alias("id"), F.lit(0).alias("tags"), F.lit(q.article_type).cast("smallint").alias("article_type"), F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("term"), "data_offset", "data_length")


def property_search(properties: DataFrame, q: SearchQuery) -> DataFrame:
    page = page_ids(properties, "pid", q)
    return page.select(F.col("pid").alias("id"), F.lit(0).alias("tags"), F.lit(q.article_type).cast("smallint").alias("article_type"), F.col("label").alias("title"), F.coalesce("description", F.lit("")).alias("term"), F.lit(0).cast("long").alias("data_offset"), F.lit(0).alias("data_length"))


def content_chunks(content: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, chunk and piece: bodies in pieces of `size` characters, at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.length("body") / size)).cast("int")
    return content.select(*keys, "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(*keys, "chunk", F.substring(F.col("body"), F.col("chunk") * size + 1, F.lit(size)).alias("piece"))


class Database:
    """Tables of a folder (or given ones) and the searches over them."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, indexes: set[str] | None = None) -> Database:
        """Read the manifest, check the format, and register the tables as views; a missing table that was asked for is an error."""
        from ..plans.manifest import read_manifest

        names = read_manifest(spark, path)["tables"]
        wanted = set(indexes) | {"entity_payloads"} if indexes else set(names)
        if missing := wanted - set(names):
            raise ValueError(f"no such table: {', '.join(sorted(missing))}")
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in sorted(wanted)}
        for n, t in tables.items():
            t.createOrReplaceTempView(n)
        return cls(tables)

    def search(self, q: SearchQuery) -> DataFrame:
        t = self.tables
        if q.kind == "text":
            out = text_search(t["omni_terms"], t["entity_payloads"], q)
        elif q.kind == "date":
            out = date_search(t["temporal_terms"], t["entity_payloads"], q)
        elif q.kind == "globe":
            out = radius_search(t["globe_terms"], t["entity_payloads"], q, geo.EARTH)
        elif q.kind == "astro":
            out = radius_search(t["astro_terms"], t["entity_payloads"], q, geo.CELESTIAL)
        elif q.kind == "qid":
            out = id_search(t["entity_payloads"], q)
        elif q.kind == "pid":
            out = property_search(t["properties"], q)
        else:
            raise ValueError(f"unknown kind of search: {q.kind}")
        return out.limit(q.limit) if q.limit is not None else out

    def iter_results(self, q: SearchQuery) -> Iterator[Row]:
        """One result at a time, a partition in memory."""
        return self.search(q).toLocalIterator()

    def content(self, results: DataFrame) -> DataFrame:
        """Results with their bodies; only they are read from the content table."""
        c = self.tables["content"].select(F.col("qid").alias("id"), F.col("project_id").alias("article_type"), "body")
        return results.join(c, ["id", "article_type"], "left")

    def read(self, qid: int, project_id: int, chunk: int = 4096) -> Iterator[str]:
        """A payload in pieces."""
        one = self.tables["content"].where((F.col("qid") == qid) & (F.col("project_id") == project_id)).limit(1)
        return (r["piece"] for r in content_chunks(one, ["qid"], chunk).orderBy("chunk").toLocalIterator())


def ranges_join(points: DataFrame, code: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Points with the number of the range that holds them, for few ranges: an expression instead of a join."""
    number = reduce(lambda acc, r: F.when(F.col(code).between(r[1][0], r[1][1]), F.lit(r[0])).otherwise(acc), reversed(list(enumerate(ranges))), F.lit(None).cast("int"))
    return points.where(geo.in_ranges(F.col(code), ranges)).withColumn("range_no", number)


def per_archive(rows: DataFrame, archive: str, order: str, n: int) -> DataFrame:
    """The first n rows of each archive (window group limit: each task passes on n a group at most)."""
    w = Window.partitionBy(archive).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
