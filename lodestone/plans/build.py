"""The build: a dump and pages to a database, stage by stage, each written before its checkpoint so that a run can go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compression
from ..functions import text as T
from ..operators import articles, entities, offsets, tags
from ..sources import dump
from .checkpoints import Checkpoints, purge
from .manifest import write_database
from .settings import Settings

#: Folders of a build that hold work in progress, and the finished database.
WORK, DATABASE = ("described", "closure", "relations", "articles", "anomalies", "unresolved", "content_rows", "metadata_rows", "samples", "reports", "markers"), ("database",)
TEST_LINES, TEST_ARTICLES = 2_000, 2_000


class Build:
    """Stages over `folder`. pages: page_id, lang, title, url, html (and namespace, is_redirect where they are known); projects: project_id, lang."""

    def __init__(self, spark: SparkSession, folder: str, lines: DataFrame, pages: DataFrame, projects: DataFrame, settings: Settings, test: bool = False):
        self.spark, self.folder, self.settings = spark, folder, settings
        self.lines = lines.limit(TEST_LINES) if test else lines
        self.pages, self.projects, self.test = pages, projects, test
        self.marks = Checkpoints(spark, f"{folder}/markers")

    def stages(self) -> list[tuple[str, Callable[[], None]]]:
        return [("parse", self.parse), ("dictionary", self.dictionary), ("articles", self.articles), ("metadata", self.metadata), ("database", self.database)]

    def run(self, resume: bool = True) -> list[str]:
        """Do what is not done yet (everything without resume); the titles of the stages that ran."""
        if not resume:
            self.marks.clear()
            purge(self.spark, self.folder, WORK + DATABASE)
        ran = []
        for number, (title, stage) in enumerate(self.stages()):
            if number >= self.marks.repair():
                stage()
                self.marks.mark(number, title)
                ran.append(title)
        return ran

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def parse(self) -> None:
        """Lines to entities once, then each relation from what was written."""
        s = self.settings
        described = self._write("described", entities.describe(entities.parse_lines(self.lines), s))
        vocabulary = self.spark.createDataFrame([(t,) for t in s.all_tags()], "tag string")
        closure = self._write("closure", tags.subclass_closure(entities.entity_edges(described, s), vocabulary, offsets.fixed))
        for name, df in entities.route(described, closure, s).items():
            self._write(f"relations/{name}", df)
        self._report("parse", entities.metrics(described))

    def _report(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").json(f"{self.folder}/reports/{name}")

    def dictionary(self) -> None:
        """A dictionary of sampled pages, and its report."""
        cleaned = articles.clean_pages(self.pages, self.read("relations/sitelinks"), ["page_id"]).where("error is null")
        sized = cleaned.select("page_id", "body", F.octet_length("body").alias("size"))
        sample = self._write("samples", offsets.byte_sample(sized, "size", ["page_id"], compression.SAMPLE_BYTES))
        packed = compression.compress(sample, "body", "packed", compression.train_dictionary(sample, "body"))
        self._report("compression", compression.ratio_report(packed, F.octet_length("body"), F.length("packed")))

    def articles(self) -> None:
        """Pages to bodies; pages without an entity and pages that fail go elsewhere."""
        own = self.pages
        if {"namespace", "is_redirect"} <= set(own.columns):
            own = articles.article_pages(own)
        links = self.read("relations/sitelinks")
        found, missing = articles.resolve_pages(own, links)
        if self.test:
            from ..operators.search import per_archive

            found = per_archive(found, "lang", "page_id", TEST_ARTICLES)
        cleaned = articles.clean_pages(found, links, ["page_id"])
        good, bad = articles.split_anomalies(cleaned, found, ["page_id"])
        facts = found.select("page_id", "lang", "title", "qid")
        rows = good.join(facts, "page_id").join(self.projects, "lang").select(T.parse_id(F.col("qid")).alias("qid"), "project_id", "title", T.envelope(F.col("qid"), F.col("body")).alias("body"))
        self._write("content_rows", rows.groupBy("qid", "project_id").agg(F.min(F.struct("title", "body")).alias("r")).select("qid", "project_id", "r.title", "r.body"))
        failed = self._write("anomalies", bad.join(facts, "page_id").select("qid", "lang", "title", "error_msg", "raw_content"))
        missing = self._write("unresolved", missing.select("lang", "title"))
        self._report("articles", articles.article_metrics(found, missing, failed))

    def metadata(self) -> None:
        """The metadata relation as payload rows of project 0."""
        own = self.read("relations/metadata").select("qid", F.lit(0).cast("smallint").alias("project_id"), F.lit("").alias("title"), "body")
        self._write("metadata_rows", own)

    def database(self) -> None:
        """Offsets of both sections, then all tables, then the manifest."""
        both = self.read("content_rows").select("qid", F.col("project_id").cast("smallint").alias("project_id"), "title", "body").unionByName(self.read("metadata_rows"))
        placed = self._write("articles", articles.content_store(both, ["project_id", "qid"]))
        named = self.read("relations/property_rows").join(self.projects, "lang").select("pid", F.col("project_id").cast("smallint").alias("project_id"), "lang", "label", "description", "datatype")
        relations = {n: self.read(f"relations/{n}") for n in ("omni_terms", "globe_terms", "temporal_terms", "astro_terms")}
        tables = relations | {"entity_payloads": placed.drop("body"), "content": placed.select("qid", "project_id", "body"), "properties": named}
        purge(self.spark, self.folder, DATABASE)
        write_database(self.spark, tables, f"{self.folder}/database")


def build_from_files(spark: SparkSession, folder: str, dump_path: str, pages_path: str, projects: DataFrame, settings: Settings, test: bool = False) -> Build:
    """A build over a dump's lines and Parquet pages."""
    return Build(spark, folder, dump.dump_lines(spark, dump_path), spark.read.parquet(pages_path), projects, settings, test)
