"""Every reference query equals its SQL; tables that were written open again; helpers hold against small brute force."""

import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import compression
from lodestone.operators import offsets, tags
from lodestone.operators.search import Database, SearchQuery
from lodestone.plans import manifest
from lodestone.queries import views


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, same_as_sql, name):
    out = queries.QUERIES[name](spark, SMALL)
    if name in queries.SQL:
        same_as_sql(out, queries.SQL[name])
    else:
        assert out.count()


def test_database_opens_what_was_written(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    manifest.write_database(spark, {"omni_terms": views.part_terms(spark, SMALL), "entity_payloads": views.part_payloads(spark, SMALL)}, path)
    db = Database.open(spark, path)
    q = SearchQuery("text", 1, text="b")
    got = db.search(q).collect()
    want = Database({"omni_terms": views.part_terms(spark, SMALL), "entity_payloads": views.part_payloads(spark, SMALL)}).search(q).collect()
    assert got == want and got
    with pytest.raises(ValueError):
        Database.open(spark, path, {"globe_terms"})
    with pytest.raises(ValueError):
        db.search(SearchQuery("other"))


def test_other_formats_are_refused(spark, tmp_path):
    spark.createDataFrame([("other", 9, ["x"])], "format string, version int, tables array<string>").write.json(f"file://{tmp_path}/db/_tables")
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, f"file://{tmp_path}/db")


def test_running_sum(spark):
    rows = [(i, i * 7 % 13) for i in range(200)]
    got = offsets.running_sum(spark.createDataFrame(rows, "k int, v int"), ["k"], F.col("v"), "before").orderBy("k").collect()
    assert [r["before"] for r in got] == [sum(v for _, v in rows[:i]) for i in range(200)]


def test_closure_takes_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (9, 8)], "child int, parent int")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = tags.subclass_closure(edges, spark.createDataFrame([(1,)], "tag int")).collect()
    assert sorted((r["child"], r["tag"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("name, times", [("used_anywhere", 1), ("tag_join", 1), ("dump_tag_usage", 1), ("entity_metadata", 1), ("sitelink_filter", 1), ("parse_sanity_checks", 2), ("entity_route", 2), ("entity_route_astro", 2)])
def test_lines_are_parsed_once(spark, name, times):
    """A relation parses a line once, and once more where it has to have the tags; conditions don't parse it again."""
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == times


def test_few_parts_reach_all_cores(spark):
    assert queries.ingest.lines(spark, SMALL).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_pieces_of_a_batch(monkeypatch):
    monkeypatch.setattr(compression, "PIECE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e" * 9, "é"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "text": texts})
    found = list(compression._pieces(batch, "text"))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert [b.num_rows for b in found] == [3, 1, 1, 2, 1]
    assert not list(compression._pieces(batch.slice(0, 0), "text"))
