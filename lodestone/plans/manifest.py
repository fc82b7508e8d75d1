"""Written databases: range-sorted Parquet tables beside a manifest that names format, version and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMAT, VERSION = "lodestone", 1
#: Order of each table's rows: scans by these columns read few row groups.
ORDER = {
    "omni_terms": ("term", "qid"), "temporal_terms": ("date_code", "qid"), "globe_terms": ("morton", "qid"), "astro_terms": ("morton", "qid"),
    "entity_payloads": ("qid", "project_id"), "properties": ("pid", "project_id"), "content": ("qid", "project_id"),
}


def write_table(df: DataFrame, name: str, path: str, files: int | None = None) -> None:
    """One table, range-partitioned and sorted in its order."""
    keys = ORDER[name]
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def write_database(spark: SparkSession, tables: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """Write the tables, range-partitioned and sorted, then the manifest: a folder without one is not complete."""
    if unknown := set(tables) - set(ORDER):
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    for name, df in sorted(tables.items()):
        write_table(df, name, f"{path}/{name}", files)
    spark.createDataFrame([(FORMAT, VERSION, sorted(tables))], "format string, version int, tables array<string>").coalesce(1).write.json(f"{path}/_tables")


def merge_databases(spark: SparkSession, paths: list[str], path: str) -> None:
    """One database of several: the rows of each table of theirs together, in order again."""
    tables: dict[str, DataFrame] = {}
    for p in paths:
        for name in read_manifest(spark, p)["tables"]:
            own = spark.read.parquet(f"{p}/{name}")
            tables[name] = tables[name].unionByName(own) if name in tables else own
    write_database(spark, tables, path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Format, version and tables; another format or version is an error."""
    row = spark.read.schema("format string, version int, tables array<string>").json(f"{path}/_tables").first()  # one row
    if row is None or (row["format"], row["version"]) != (FORMAT, VERSION):
        raise ValueError(f"{path} is not a {FORMAT} database of version {VERSION}")
    return row.asDict()
