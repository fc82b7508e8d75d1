"""Incremental ingestion: files that arrive are read once, whatever the number of runs, by Structured Streaming's file source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, state: str, file_format: str = "parquet") -> int:
    """Append transform(new rows) to `out` and return when all files there are done; the number of batches of this run.

    The checkpoint in `state` has the files that are done: a later run, also after a failure, reads only others. Every row passes exactly once.
    """
    reader = spark.readStream.schema(schema)
    rows = reader.text(source) if file_format == "text" else reader.format(file_format).load(source)
    query = transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def dedup_stream(rows: DataFrame, key: str, time: str, window: str) -> DataFrame:
    """The first row of each key within a time window; what is kept of keys is bounded by the watermark."""
    return rows.withWatermark(time, window).dropDuplicatesWithinWatermark([key])
