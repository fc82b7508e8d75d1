"""Views of the driver tables in the engine's data model, in Spark and in SQL: integer arithmetic on keys only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..plans.manifest import write_table

POSITION = "({k} * 7919 % 180001) / 1000.0D - 90.0D AS lat, ({k} * 104729 % 360000) / 1000.0D - 180.0D AS lon"
POSITION_SQL = "({k} * 7919 % 180001) / 1000.0::DOUBLE - 90.0::DOUBLE AS lat, ({k} * 104729 % 360000) / 1000.0::DOUBLE - 180.0::DOUBLE AS lon"
TYPES = "CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 4 WHEN 'LARGE' THEN 8 WHEN 'ECONOMY' THEN 16 ELSE 32 END + CASE WHEN p_size % 2 = 0 THEN 64 ELSE 0 END"
PRIORITY = "CAST(substring(o_orderpriority, 1, 1) AS int)"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame], kind: str) -> DataFrame:
    """A view as a database has it: written once a session in its table's order, so that searches prune row groups and codes aren't computed by each."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestone-")
        path = f"{folder}/views-{uuid.uuid4().hex}/{name}"
        write_table(make(), kind, path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def part_terms(spark, d) -> DataFrame:
    return read(spark, d, "part").selectExpr("lower(p_name) AS term", "p_partkey + 1 AS qid", f"{TYPES} AS tags")


def part_payloads(spark, d) -> DataFrame:
    one = "p_partkey + 1 AS qid", "CAST({} AS smallint) AS project_id", "p_name AS title", "p_partkey * 10 AS data_offset", "p_size AS data_length"
    p = read(spark, d, "part")
    return p.selectExpr(*[x.format("p_partkey % 4") for x in one]).union(p.selectExpr(*[x.format("(p_partkey + 1) % 4") for x in one]))


def order_terms(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(dates.encode_date(F.date_format("o_orderdate", "'+'yyyy-MM-dd")).alias("date_code"), (F.col("o_custkey") + 1).alias("qid"), F.lit("P571").alias("pid"), F.expr(f"shiftleft(1, {PRIORITY})").alias("tags"))


def customer_payloads(spark, d) -> DataFrame:
    return read(spark, d, "customer").selectExpr("c_custkey + 1 AS qid", "CAST(c_custkey % 4 AS smallint) AS project_id", "c_name AS title", "c_custkey * 7 AS data_offset", "c_nationkey AS data_length")


def customer_globe(spark, d) -> DataFrame:
    return stored(spark, d, "customer_globe", lambda: _customer_globe(spark, d), "globe_terms")


def part_astro(spark, d) -> DataFrame:
    return stored(spark, d, "part_astro", lambda: _part_astro(spark, d), "astro_terms")


def _customer_globe(spark, d) -> DataFrame:
    c = read(spark, d, "customer").selectExpr("c_custkey + 1 AS qid", *POSITION.format(k="c_custkey").split(", "), "shiftleft(1, length(c_mktsegment) % 5) AS tags")
    return c.withColumn("morton", geo.encode(F.col("lat"), F.col("lon")))


def _part_astro(spark, d) -> DataFrame:
    lat, lon = POSITION.format(k="p_partkey").split(", ")
    c = read(spark, d, "part").selectExpr("p_partkey + 1 AS qid", lat, lon.replace(" - 180.0D", ""), f"{TYPES} AS tags")
    return c.withColumn("morton", geo.encode(F.col("lat"), F.col("lon"), geo.CELESTIAL))


SQL = {
    "part_terms": f"SELECT lower(p_name) AS term, p_partkey + 1 AS qid, {TYPES} AS tags FROM part",
    "part_payloads": "SELECT p_partkey + 1 AS qid, x.project_id, p_name AS title, p_partkey * 10 AS data_offset, p_size AS data_length FROM part, LATERAL (SELECT unnest([p_partkey % 4, (p_partkey + 1) % 4]) AS project_id) x",
    "order_terms": f"SELECT year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS date_code, o_custkey + 1 AS qid, 1 << {PRIORITY} AS tags FROM orders",
    "customer_payloads": "SELECT c_custkey + 1 AS qid, c_custkey % 4 AS project_id, c_name AS title, c_custkey * 7 AS data_offset, c_nationkey AS data_length FROM customer",
    "customer_globe": f"SELECT c_custkey + 1 AS qid, {POSITION_SQL.format(k='c_custkey')}, 1 << (length(c_mktsegment) % 5)::INT AS tags FROM customer",
    "part_astro": f"SELECT p_partkey + 1 AS qid, {POSITION_SQL.format(k='p_partkey').replace(' - 180.0::DOUBLE', '')}, {TYPES} AS tags FROM part",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
