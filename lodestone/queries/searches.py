"""Searches over views of the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dates, geo
from ..operators import search as S
from . import views as V

QUERIES, SQL = {}, {}
COLUMNS = "id, tags, article_type, title, term, data_offset, data_length"


def _casts(df):
    return df.select(F.col("id").cast("long"), F.col("tags").cast("long"), F.col("article_type").cast("long"), "title", "term", F.col("data_offset").cast("long"), F.col("data_length").cast("long"))


def _add(name, run, sql):
    QUERIES[name] = lambda spark, d: run(spark, d)
    SQL[name] = sql


def _result_sql(hits: str, payloads: str, project: int, tail: str = "") -> str:
    """hits has qid, tags, term and scan; the first of each qid, joined with a payload of the project."""
    return f""", hits AS ({hits}), firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY scan, tags, term) = 1)
SELECT qid::BIGINT AS id, tags::BIGINT AS tags, {project}::BIGINT AS article_type, title, term, data_offset::BIGINT AS data_offset, data_length::BIGINT AS data_length
FROM firsts JOIN (SELECT DISTINCT * FROM {payloads} WHERE project_id = {project}) p USING (qid) {tail}"""


def _text(prefix, project=1, inc=0, exc=0):
    q = S.SearchQuery("text", project, inc, exc, text=prefix)
    cond = f"starts_with(term, '{prefix.lower()}') AND (tags & {inc}) = {inc} AND (tags & {exc}) = 0"
    return lambda s, d: _casts(S.text_search(V.part_terms(s, d), V.part_payloads(s, d), q)), V.with_views("part_terms", "part_payloads") + _result_sql(f"SELECT qid, tags, term, term AS scan FROM part_terms WHERE {cond}", "part_payloads", project)


_add("omni_prefix", *_text("S"))
_add("omni_prefix_tags", *_text("b", 1, 64, 1))
_add("omni_empty_prefix", *_text("", 2))


def _multi(s, d):
    out = None
    for project in range(4):
        one = _casts(S.text_search(V.part_terms(s, d), V.part_payloads(s, d), S.SearchQuery("text", project, text="b")))
        out = one if out is None else out.union(one)
    return out


_add("omni_multi_lang", _multi, V.with_views("part_terms", "part_payloads") + " SELECT DISTINCT t.qid::BIGINT AS id, tags::BIGINT AS tags, project_id::BIGINT AS article_type, title, term, data_offset::BIGINT AS data_offset, data_length::BIGINT AS data_length FROM part_terms t JOIN part_payloads p USING (qid) WHERE starts_with(term, 'b')")


def _date(code, backward, inc=0):
    q = S.SearchQuery("date", 1, inc, date=code, backward=backward)
    op, sign = ("<=", "-") if backward else (">=", "")
    hits = f"SELECT qid, tags, date_code, {sign}date_code AS scan, format('{{:d}}-{{:02d}}-{{:02d}}', date_code // 10000, date_code // 100 % 100, date_code % 100) AS term FROM order_terms WHERE date_code {op} {code} AND (tags & {inc}) = {inc}"
    return lambda s, d: _casts(S.date_search(V.order_terms(s, d), V.customer_payloads(s, d), q)), V.with_views("order_terms", "customer_payloads") + _result_sql(hits, "customer_payloads", 1)


_add("temporal_forward", *_date(19980101, False))
_add("temporal_backward", *_date(19970615, True))
_add("temporal_forward_tags", *_date(19960101, False, 4))


def _chord(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return f"(cos(radians(lat)) * cos(radians(lon)) - {math.cos(a) * math.cos(b)!r})**2 + (cos(radians(lat)) * sin(radians(lon)) - {math.cos(a) * math.sin(b)!r})**2 + (sin(radians(lat)) - {math.sin(a)!r})**2"


def _radius(view, payloads, sphere, lat, lon, r, project, k=None, inc=0):
    kind = "globe" if sphere is geo.EARTH else "astro"
    q = S.SearchQuery(kind, project, inc, lat=lat, lon=lon, radius=r, sort_by_distance=k is not None, max_results=k or 0)
    name = {"customer_globe": V.customer_globe, "part_astro": V.part_astro}[view]
    pay = {"customer_payloads": V.customer_payloads, "part_payloads": V.part_payloads}[payloads]
    hits = f"SELECT qid, tags, format('{{:.4f}}, {{:.4f}}', lat, lon) AS term, {_chord(lat, lon)} AS scan FROM {view} WHERE {_chord(lat, lon)} <= {geo.radius_chord_squared(r, sphere)!r} AND (tags & {inc}) = {inc}"
    return lambda s, d: _casts(S.radius_search(name(s, d), pay(s, d), q, sphere)), V.with_views(view, payloads) + _result_sql(hits, payloads, project, f"ORDER BY scan, qid LIMIT {k}" if k else "")


_add("globe_radius_stream", *_radius("customer_globe", "customer_payloads", geo.EARTH, 48.8584, 2.2945, 2500.25, 1))
_add("globe_radius_pole", *_radius("customer_globe", "customer_payloads", geo.EARTH, 89.5, 10.0, 3000.25, 2))
_add("globe_radius_seam", *_radius("customer_globe", "customer_payloads", geo.EARTH, -10.0, 179.5, 2000.25, 1))
_add("globe_topk", *_radius("customer_globe", "customer_payloads", geo.EARTH, 10.0, 20.0, 9000.25, 1, 20))
_add("globe_topk_tags", *_radius("customer_globe", "customer_payloads", geo.EARTH, 10.0, 20.0, 15000.25, 1, 10, 1))
_add("astro_radius", *_radius("part_astro", "part_payloads", geo.CELESTIAL, 20.0, 359.0, 25.025, 1))
_add("astro_topk", *_radius("part_astro", "part_payloads", geo.CELESTIAL, -40.0, 83.0, 60.025, 2, 15))


def _cover(s, d):
    hits = V.customer_globe(s, d).where(geo.in_ranges(F.col("morton"), geo.radius_cover(48.8584, 2.2945, 1500.25)))
    return hits.where(geo.chord_squared(F.col("lat"), F.col("lon"), 48.8584, 2.2945) <= geo.radius_chord_squared(1500.25)).select("qid")


_add("radius_cover_hits", _cover, V.with_views("customer_globe") + f" SELECT qid FROM customer_globe WHERE {_chord(48.8584, 2.2945)} <= {geo.radius_chord_squared(1500.25)!r}")

_RANGES = [(i * (1 << 40), i * (1 << 40) + (1 << 38)) for i in range(0, 16, 3)]
_MORTON_SQL = """cells AS (SELECT *, least(4194303, greatest(0, trunc(((CASE WHEN y > 180 THEN 360::REAL - y ELSE y END) / 180::REAL) * 4194303::REAL)))::BIGINT AS gy,
  least(4194303, greatest(0, trunc((x / 360::REAL) * 4194303::REAL)))::BIGINT AS gx FROM (SELECT *, (lat::REAL + 90::REAL)::REAL AS y, CASE WHEN (lon::REAL + 180::REAL) >= 360 THEN (lon::REAL + 180::REAL) - 360::REAL ELSE lon::REAL + 180::REAL END AS x FROM customer_globe)),
coded AS (SELECT *, (SELECT sum((((gx >> i) & 1) << (2 * i)) | (((gy >> i) & 1) << (2 * i + 1))) FROM range(22) r(i))::BIGINT AS morton FROM cells)"""
_add("morton_encode", lambda s, d: V.customer_globe(s, d).select("qid", "morton"), V.with_views("customer_globe") + ", " + _MORTON_SQL + " SELECT qid, morton FROM coded")
_add(
    "morton_decode",
    lambda s, d: V.customer_globe(s, d).select("qid", *[F.round(c, 6).alias(n) for c, n in zip(geo.decode(F.col("morton")), ("lat6", "lon6"))]),
    V.with_views("customer_globe") + ", " + _MORTON_SQL + " SELECT qid, round(gy / 4194303.0::DOUBLE * 180.0 - 90.0, 6) AS lat6, round(gx / 4194303.0::DOUBLE * 360.0 - 180.0, 6) AS lon6 FROM coded",
)
_add("range_join", lambda s, d: S.ranges_join(V.customer_globe(s, d), "morton", _RANGES).select("qid", F.col("range_no").cast("long").alias("range_no")), V.with_views("customer_globe") + ", " + _MORTON_SQL + ", ranges AS (SELECT i // 3 AS range_no, i * (1::BIGINT << 40) AS lo, i * (1::BIGINT << 40) + (1::BIGINT << 38) AS hi FROM range(0, 16, 3) r(i)) SELECT qid, range_no::BIGINT AS range_no FROM coded JOIN ranges ON morton BETWEEN lo AND hi")


def _page(target, backward, strict):
    q = S.SearchQuery("qid", 1, target_id=target, backward=backward, must_match=strict)
    start = 1 if target == 0 and not backward and not strict else target
    snap = backward and not strict
    cond = f"qid {'<=' if backward else '>='} {start} AND {start} > 0" + ("" if snap else f" AND {start} <= (SELECT max(qid) FROM customer_payloads)") + (f" AND EXISTS (SELECT 1 FROM customer_payloads WHERE project_id = 1 AND qid = {start})" if strict else "")
    return lambda s, d: _casts(S.id_search(V.customer_payloads(s, d), q)), V.with_views("customer_payloads") + f" SELECT qid::BIGINT AS id, 0::BIGINT AS tags, 1::BIGINT AS article_type, title, '' AS term, data_offset::BIGINT AS data_offset, data_length::BIGINT AS data_length FROM customer_payloads WHERE project_id = 1 AND {cond}"


for _name, _args in {"qid_page_forward": (100, False, False), "qid_page_backward": (100, True, False), "qid_page_strict_hit": (102, False, True), "qid_page_strict_miss": (101, False, True), "qid_page_zero": (0, False, False), "qid_page_snap": (10**9, True, False), "qid_page_beyond": (10**9, False, False)}.items():
    _add(_name, *_page(*_args))


def _properties(s, d):
    n, r = V.read(s, d, "nation"), V.read(s, d, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).selectExpr("CAST(n_nationkey + 1 AS long) AS pid", "CAST(1 AS smallint) AS project_id", "n_name AS label", "r_name AS description")


_add("pid_lookup_lang", lambda s, d: _casts(S.property_search(_properties(s, d), S.SearchQuery("pid", 1, target_id=5))), "SELECT (n_nationkey + 1)::BIGINT AS id, 0::BIGINT AS tags, 1::BIGINT AS article_type, n_name AS title, r_name AS term, 0::BIGINT AS data_offset, 0::BIGINT AS data_length FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 4")
_add("dedup_first_hit", lambda s, d: S.first_per_entity(V.read(s, d, "lineitem").selectExpr("l_partkey AS qid", "l_orderkey", "l_linenumber"), F.col("l_orderkey"), F.col("l_linenumber")), "SELECT l_partkey AS qid, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
_add("content_chunks", lambda s, d: S.content_chunks(V.read(s, d, "documents").selectExpr("doc_id", "text AS body"), ["doc_id"], 512), "SELECT doc_id, i::INT AS chunk, substring(text, i * 512 + 1, 512) AS piece FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, ceil(length(text) / 512.0))::BIGINT)) AS i)")
_add("archive_limit", lambda s, d: S.per_archive(V.read(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 20), "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
_LITERALS = "+1969-07-20T00:00:00Z", "-0500-01-01T00:00:00Z", "+1952-00-00T00:00:00Z", "", "abc", "1969-07-20", "-13798000000-00-00T00:00:00Z"


def _dates(s, d):
    rows = s.createDataFrame([(x,) for x in _LITERALS], "text string").select("text", dates.encode_date(F.col("text")).alias("code"))
    rows = rows.union(V.read(s, d, "orders").select(F.date_format("o_orderdate", "'+'yyyy-MM-dd").alias("text"), dates.encode_date(F.date_format("o_orderdate", "'+'yyyy-MM-dd")).alias("code")).distinct())
    y, m, day = dates.decode_date(F.col("code"))
    return rows.select("text", "code", y.alias("y"), m.alias("m"), day.alias("d"), dates.format_date(F.col("code")).alias("shown"))


_add(
    "temporal_encode_decode",
    _dates,
    r"""WITH t AS (SELECT unnest(['+1969-07-20T00:00:00Z', '-0500-01-01T00:00:00Z', '+1952-00-00T00:00:00Z', '', 'abc', '1969-07-20', '-13798000000-00-00T00:00:00Z']) AS text UNION SELECT DISTINCT strftime(o_orderdate, '+%Y-%m-%d') FROM orders),
p AS (SELECT text, regexp_extract(text, '^(.)([0-9]+)-([0-9]+)-([0-9]+)', ['s', 'y', 'm', 'd']) AS r FROM t),
c AS (SELECT text, CASE WHEN r.y = '' THEN -1 ELSE (CASE WHEN r.s = '-' THEN -1 ELSE 1 END) * try_cast(r.y AS BIGINT) * 10000 + try_cast(r.m AS BIGINT) * 100 + try_cast(r.d AS BIGINT) END AS code FROM p),
e AS (SELECT text, code, ((code % 10000) + 10000) % 10000 AS rest FROM c)
SELECT text, code, (code - rest) // 10000 AS y, (rest // 100)::INT AS m, (rest % 100)::INT AS d, format('{:d}-{:02d}-{:02d}', (code - rest) // 10000, rest // 100, rest % 100) AS shown FROM e""",
)
