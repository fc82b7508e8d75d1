"""Article ingestion: pages to bodies, dead letters apart, and the content store with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from . import links, offsets

#: Namespaces that hold articles. Fixed values.
ARTICLE_NAMESPACES = ("A", "C")


def article_pages(pages: DataFrame) -> DataFrame:
    """Pages of article namespaces that are no redirects; needs namespace and is_redirect."""
    return pages.where(F.col("namespace").isin(*ARTICLE_NAMESPACES) & ~F.coalesce("is_redirect", F.lit(False)))


def resolve_pages(pages: DataFrame, sitelinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (lang, title, url, …) with their qid, and those without one."""
    own = links.lookup(pages, sitelinks, F.col("lang"), F.col("title"), F.col("url"))
    return own.where(F.col("qid").isNotNull()), own.where(F.col("qid").isNull()).drop("qid")


def link_ids(pages: DataFrame, sitelinks: DataFrame, keys: list[str], html: str = "html", lang: str = "lang") -> DataFrame:
    """keys and `ids`, a map from href to id, of the internal links of each page: links are exploded, looked up by equi-joins, and put together by page.

    A title that very many pages link to meets its few sitelink rows in a join that adaptive execution can split; a page's own
    links are the bound of what meets in one row.
    """
    rows = links.extract_links(pages, [*keys, lang], html).where("kind = 'internal'").select(*keys, lang, "href").distinct()
    target = F.regexp_replace("href", r"^(\./|/wiki/|/)", "")
    found = links.lookup(rows.withColumn("target", target), sitelinks, F.col(lang), F.lit(""), F.col("target")).where("qid is not null")
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("href", "qid"))).alias("ids"))


def clean_pages(pages: DataFrame, sitelinks: DataFrame, keys: list[str], html: str = "html", lang: str = "lang") -> DataFrame:
    """keys, body, tables, links and error of each page, internal links marked with the ids that `sitelinks` knows and Q0 elsewhere."""
    linked = pages.join(link_ids(pages, sitelinks, keys, html, lang), keys, "left")
    return H.html_to_text(linked, keys, html, ids="ids")


def split_anomalies(cleaned: DataFrame, raw: DataFrame, keys: list[str], html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Pages that have a body, and dead letters: keys, error_msg and raw_content."""
    good = cleaned.where(F.col("error").isNull()).drop("error")
    bad = cleaned.where(F.col("error").isNotNull()).select(*keys, F.col("error").alias("error_msg")).join(raw.select(*keys, F.col(html).alias("raw_content")), keys)
    return good, bad


def article_metrics(found: DataFrame, unresolved: DataFrame, failed: DataFrame, lang: str = "lang") -> DataFrame:
    """lang, processed, skipped, failed, total, and the share processed in percent."""
    rows = found.select(lang, F.lit("processed").alias("kind")).union(unresolved.select(lang, F.lit("skipped"))).union(failed.select(lang, F.lit("failed")))
    per = rows.groupBy(lang).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("processed", "skipped", "failed")], F.count(F.lit(1)).alias("total"))
    return per.withColumn("percent", F.round(100 * F.col("processed") / F.col("total"), 3))


def content_store(articles: DataFrame, order: list[str], body: str = "body") -> DataFrame:
    """Articles with data_length (UTF-8 bytes of the envelope that is stored) and data_offset in the given order."""
    stored = articles.withColumn("data_length", F.octet_length(body).cast("long"))
    return offsets.running_sum(stored, order, F.col("data_length"), "data_offset")


def absolute_offset(project_id: Column, offset: Column, metadata_base: int, content_base: int) -> Column:
    """Place of a payload in the database: its section's start, that of metadata for project 0, and its offset there."""
    return F.when(project_id == 0, F.lit(metadata_base)).otherwise(F.lit(content_base)).cast("long") + offset


def read_payload(store: DataFrame, offset: int, length: int, capacity: int, body: str = "body") -> DataFrame:
    """chunk and bytes of the region [offset, offset + length) of a store, at most `capacity` bytes each.

    A region that isn't inside the store is an error. Only rows that overlap it are read: the predicate reaches the scan of a
    store that was written in order of data_offset.
    """
    end = store.agg(F.max(F.col("data_offset") + F.col("data_length"))).first()[0] or 0
    if offset < 0 or length < 0 or offset + length > end:
        raise ValueError(f"bytes {offset} to {offset + length} are not within {end}")
    rows = store.where((F.col("data_offset") < offset + length) & (F.col("data_offset") + F.col("data_length") > offset))
    lo = F.greatest(F.lit(offset).cast("long") - F.col("data_offset"), F.lit(0))
    hi = F.least(F.lit(offset + length).cast("long") - F.col("data_offset"), F.col("data_length"))
    part = F.substring(F.encode(body, "utf-8"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    at = F.col("data_offset") + lo - F.lit(offset)  # place in the region
    cuts = F.explode(F.sequence(F.floor(at / capacity), F.floor((at + hi - lo - 1) / capacity)))
    pieces = rows.where(hi > lo).select(part.alias("part"), at.alias("at"), cuts.alias("chunk"))
    start = F.greatest(F.col("chunk") * capacity - F.col("at"), F.lit(0))
    stop = F.least((F.col("chunk") + 1) * capacity - F.col("at"), F.octet_length("part").cast("long"))
    pieces = pieces.select("chunk", "at", F.substring("part", (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece"))))  # a chunk's pieces: at most `capacity` bytes
    return pieces.groupBy("chunk").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")).alias("bytes"))


def drop_sections(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines without the unwanted sections: a heading that starts one drops itself and what follows until the next heading of any level."""
    bare = F.trim(F.col(line))
    unwanted = F.when(bare.startswith("#"), F.coalesce(*[F.when(bare.startswith(h), F.lit(True)) for h in T.UNWANTED_SECTIONS], F.lit(False)))
    inside = F.last(unwanted, ignorenulls=True).over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("__in", F.coalesce(inside, F.lit(False))).where(~F.col("__in")).drop("__in")


def drop_empty_headings(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines without the headings that no text follows before the next heading."""
    bare = F.trim(F.col(line))
    kind = F.when(bare.startswith("#"), F.lit("heading")).when(bare != "", F.lit("text"))
    after = F.first(kind, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    rows = lines.withColumn("__kind", kind).withColumn("__after", after)
    return rows.where((F.coalesce("__kind", F.lit("")) != "heading") | (F.coalesce("__after", F.lit("")) == "text")).drop("__kind", "__after")


def normalise_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Unwanted sections, empty headings and repeated blank lines gone, borders and runs of spaces shortened: one shuffle by key."""
    own = drop_empty_headings(drop_sections(lines, key, order, line), key, order, line)
    own = links.collapse_blank(own, key, order, line)
    return own.withColumn(line, T.clean_line(F.col(line)))


def sample_titles(pages: DataFrame, titles: list[str]) -> DataFrame:
    """Pages whose title is one of a few, whatever the case."""
    return pages.where(F.lower("title").isin(*[t.lower() for t in titles]))


def minimise(text: str, fails, cut: str = "<") -> str:
    """A shorter text that still fails, by leaving out ever smaller runs of its pieces (before each `cut`)."""
    pieces = [cut + p for p in text.split(cut)]
    pieces[0] = pieces[0][len(cut) :]
    size = max(1, len(pieces) // 2)
    while True:
        i, shorter = 0, False
        while i < len(pieces):
            rest = pieces[:i] + pieces[i + size :]
            if rest and fails("".join(rest)):
                pieces, shorter = rest, True
            else:
                i += size
        if size == 1 and not shorter:
            return "".join(pieces)
        size = max(1, size // 2)
