"""The build end to end over the miniature dump, and what has no query: checkpoints, run modes, sources, cursors, plans."""

import gzip
import json
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import compression
from lodestone.functions import html as H
from lodestone.operators import articles, entities
from lodestone.operators.search import Database, SearchQuery
from lodestone.plans import manifest
from lodestone.plans.build import Build
from lodestone.plans.checkpoints import Checkpoints, purge
from lodestone.plans.settings import Settings, load_settings
from lodestone.queries import ingest, views
from lodestone.sources import dump
from lodestone.streaming import incremental


@pytest.fixture(scope="module")
def build(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('build')}"
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    own = part.selectExpr("p_partkey AS page_id", "'en' AS lang", "concat(p_name, ' ', p_partkey) AS title", "concat(p_name, '_', p_partkey) AS url", """concat('<div class="mw-parser-output"><h2>Head</h2><p>About ', p_name, ' and <a href="', replace(p_name, ' ', '_'), '_3" title="x">this</a>.</p></div>') AS html""", "'A' AS namespace", "p_partkey % 9 = 0 AS is_redirect")
    projects = spark.createDataFrame([(1, "en"), (2, "de")], "project_id int, lang string")
    b = Build(spark, folder, ingest.lines(spark, SMALL), own, projects, ingest.SETTINGS)
    assert b.run() == ["parse", "dictionary", "articles", "metadata", "database"]
    return b


def test_build_makes_a_database(spark, build):
    db = Database.open(spark, f"{build.folder}/database")
    rows = build.read("content_rows").collect()
    assert rows and all(re.match(r"--- QID: Q[0-9]+ ---\n\n## Head\n\nAbout ", r["body"]) for r in rows)
    assert any(re.search(r"this \[Q[1-9]", r["body"]) for r in rows) and any("this [Q0]" in r["body"] for r in rows)
    hits = db.search(SearchQuery("text", 1, text="")).collect()
    assert hits and {h["id"] for h in hits} <= {r["qid"] for r in rows}
    one = hits[0]
    assert "".join(db.read(one["id"], 1, 7)) == next(r["body"] for r in rows if r["qid"] == one["id"])
    assert [r["id"] for r in db.iter_results(SearchQuery("qid", 0, target_id=1, limit=3))] == sorted(r["id"] for r in db.search(SearchQuery("qid", 0, target_id=1)).collect())[:3]
    placed = build.read("articles").select("project_id", "qid", "data_offset", "data_length", "body").orderBy("project_id", "qid").collect()
    at = 0
    for r in placed:
        assert r["data_offset"] == at and r["data_length"] == len(r["body"].encode())
        at += r["data_length"]
    assert json.loads(next(iter(spark.read.text(f"{build.folder}/reports/parse").collect()))[0])["lines_read"] == 200
    assert spark.read.json(f"{build.folder}/reports/compression").first()["bulk_ratio"] > 0
    assert db.search(SearchQuery("pid", 1, target_id=1)).count() == build.read("relations/property_rows").where("lang = 'en'").count()


def test_only_asked_indexes_open(spark, build):
    db = Database.open(spark, f"{build.folder}/database", {"omni_terms"})
    assert set(db.tables) == {"omni_terms", "entity_payloads"}
    with pytest.raises(KeyError):
        db.search(SearchQuery("date"))


def test_build_goes_on_where_it_stopped(spark, build):
    assert build.run() == []
    build.marks.fs.delete(build.marks._at(2, "articles"), False)
    assert build.marks.state() == "bad" and build.run() == ["articles", "metadata", "database"] and build.marks.state() == "data"


def test_merged_databases(spark, build, tmp_path):
    path = f"file://{tmp_path}/both"
    manifest.merge_databases(spark, [f"{build.folder}/database"] * 2, path)
    n = lambda p: Database.open(spark, p).tables["omni_terms"].count()
    assert n(path) == 2 * n(f"{build.folder}/database")


def test_scans_push_predicates_down(spark, build):
    t = Database.open(spark, f"{build.folder}/database").tables
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "StringStartsWith(term,b)" in plan(t["omni_terms"].where(F.col("term").startswith("b")))
    found = plan(Database(t).search(SearchQuery("globe", 1, lat=10.0, lon=20.0, radius=500.0)))
    assert re.search(r"PushedFilters: .*(GreaterThanOrEqual\(morton|Or\()", found) and "ReadSchema: struct<lat:double,lon:double" in found
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(date_code,19500101\)", plan(Database(t).search(SearchQuery("date", 1, date=19500101))))


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(spark, f"file://{tmp_path}/marks")
    assert c.state() == "empty" and c.done() == {} and c.repair() == 0
    for i, t in enumerate("abc"):
        c.mark(i, t, f"data {t}")
    assert c.state() == "data" and c.read(1) == "data b" and c.read(7) is None
    c.fs.delete(c._at(0, "a"), False)
    assert c.state() == "bad" and c.repair() == 0 and c.done() == {}
    c.mark(0, "x")
    c.clear()
    assert c.state() == "empty"


def test_purge_stays_inside(spark, tmp_path):
    (tmp_path / "work").mkdir()
    (tmp_path / "other").mkdir()
    assert purge(spark, f"file://{tmp_path}", ("work", "missing")) == ["work"] and (tmp_path / "other").exists()
    for bad in ("../x", "/etc", "a/b", ".."):
        with pytest.raises(ValueError):
            purge(spark, f"file://{tmp_path}", (bad,))


def test_run_modes(spark, tmp_path):
    with gzip.open(tmp_path / "dump.json.gz", "wt") as f:
        f.write("\n".join(r[0] for r in ingest.lines(spark, SMALL).collect()))
    spark.createDataFrame([(1, "en", "t", "t", "<p>x</p>")], "page_id int, lang string, title string, url string, html string").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(1, "en")], "project_id int, lang string").write.parquet(f"{tmp_path}/projects")
    (tmp_path / "user.toml").write_text("languages = ['fr']\n[index]\nall_dates = true\n")
    (tmp_path / "internal.toml").write_text("languages = ['en']\n")
    files = [str(tmp_path / n) for n in ("user.toml", "internal.toml")]
    s = load_settings(*files)
    assert s == Settings(languages=("en",), all_dates=True)
    (tmp_path / "bad.toml").write_text("nothing = 1\n")
    with pytest.raises(ValueError):
        load_settings(str(tmp_path / "bad.toml"))
    args = [f"{tmp_path}/out", "--dump", f"{tmp_path}/dump.json.gz", "--pages", f"{tmp_path}/pages", "--projects", f"{tmp_path}/projects", "--settings", *files]
    assert len(cli.main(["test", *args])) == 5 and cli.main(["resume", *args]) == []
    assert "relations" in cli.main(["clean", f"{tmp_path}/out"]) and cli.main(["purge", f"{tmp_path}/out"]) == ["database"]


def test_sources(spark, tmp_path):
    for name in ("wiki_en_1.html", "wiki_de_22.html", "wiki_fr_1.html", "other.txt"):
        (tmp_path / name).write_text("x" * len(name))
    found = dump.discover(spark, f"file://{tmp_path}", r"^wiki_(\w+)_[0-9]+\.html$", ["en", "de"]).collect()
    assert [(r["lang"], r["size"]) for r in found] == [("en", 14), ("de", 15)]
    done = spark.createDataFrame([(found[0]["path"],)], "path string")
    assert [r["lang"] for r in dump.discover(spark, f"file://{tmp_path}", r"^wiki_(\w+)_[0-9]+\.html$", ["en", "de"], done).collect()] == ["de"]
    (tmp_path / "bad.jsonl").write_text('{"qid": "Q1", "lang": "en", "title": "t", "error_msg": "e", "raw_content": "<a>"}\nnot json\n')
    assert [r["qid"] for r in dump.anomalies(spark, f"file://{tmp_path}/bad.jsonl").collect()] == ["Q1"]
    (tmp_path / "p.txt").write_text("19\ten\tplace of birth\tx\tproperty\n22\tde\tVater\n")
    assert [tuple(r) for r in dump.delimited(spark, f"file://{tmp_path}/p.txt", "pid long, lang string, label string, description string, datatype string").collect()] == [(19, "en", "place of birth", "x", "property")]


def test_payload_regions(spark):
    store = articles.content_store(spark.createDataFrame([(1, "abc"), (2, ""), (3, "défg"), (4, "hi")], "k int, body string"), ["k"]).cache()
    whole = "abcdéfghi".encode()
    read = lambda a, n, c: b"".join(bytes(r["bytes"]) for r in articles.read_payload(store, a, n, c).orderBy("chunk").collect())
    for a in range(len(whole)):
        assert read(a, len(whole) - a, 3) == whole[a:]
    assert read(2, 5, 100) == whole[2:7] and read(3, 0, 5) == b""
    for a, n in ((-1, 2), (0, len(whole) + 1), (5, -1)):
        with pytest.raises(ValueError):
            articles.read_payload(store, a, n, 4)


def test_compression_without_dictionary(spark):
    df = spark.createDataFrame([("a" * 1000,), ("",), (None,)], "body string")
    packed = compression.compress(df, "body", "packed")
    assert [r["back"] for r in compression.decompress(packed, "packed", "back").collect()] == ["a" * 1000, "", None]
    assert compression.train_dictionary(df.limit(1), "body") == b""


def test_articles_with_links(spark):
    pages = spark.createDataFrame([(1, "en", '<p><a href="./Some_Page" title="Some Page">one</a>, <a href="other%20page" title="o">two</a>, <a href="Nowhere" title="n">three</a> and <a href="#x" title="f">four</a></p>')], "page_id int, lang string, html string")
    links = spark.createDataFrame([("en", "Some Page", "Q7"), ("en", "Other page", "Q8")], "lang string, title string, qid string")
    assert articles.clean_pages(pages, links, ["page_id"]).first()["body"] == "one [Q7], two [Q8], three [Q0] and four"
    assert "## A" not in H.normalise("## A\n\n## B\n\ntext") and H.normalise("=" * 120) == "=" * 80


def test_minimised_failures():
    fails = lambda t: "<b>" in t and "<i>" in t
    assert articles.minimise("<p>x<b>y</p><u>z</u><i>w" * 3, fails) in ("<b>y<i>w", "<i>w<b>y")


def test_files_are_read_once(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    write = lambda a, b: spark.range(a, b).write.mode("append").parquet(src)
    write(0, 5)
    run = lambda: incremental.ingest_new(spark, src, "id long", lambda df: df.selectExpr("id * 2 AS twice"), out, state)
    assert run() == 1 and run() == 0
    write(5, 8)
    assert run() == 1 and sorted(r[0] for r in spark.read.parquet(out).collect()) == [2 * i for i in range(8)]


def test_first_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:20")], "qid int, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.dedup_stream(spark.readStream.schema("qid int, t timestamp").parquet(f"{tmp_path}/in"), "qid", "t", "1 hour")
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["qid"] for r in spark.table("firsts").collect()) == [1, 2]


def test_over_32_tags(spark):
    described = entities.describe(entities.parse_lines(ingest.lines(spark, SMALL)), ingest.SETTINGS)
    with pytest.raises(ValueError):
        entities.class_tags(described, spark.createDataFrame([], "child string, tag string"), {"text": tuple(f"Q{i}" for i in range(33))})


def test_views_are_written_once(spark):
    assert views.customer_globe(spark, SMALL).inputFiles() == views.customer_globe(spark, SMALL).inputFiles()
