"""The build side over the driver tables: tags, counts, offsets, links, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links, offsets, tags
from ..sources import dump
from .views import read

QUERIES, SQL = {}, {}


def _add(name, run, sql):
    QUERIES[name] = run
    SQL[name] = sql


def _closure(s, d):
    ring = s.createDataFrame([(-1, -2), (-2, -3), (-3, -1)], "child long, parent long")
    edges = read(s, d, "part").where("p_partkey > 0").selectExpr("p_partkey AS child", "p_partkey div 10 AS parent").union(ring)
    return tags.subclass_closure(edges, s.createDataFrame([(1,), (2,), (17,), (-1,)], "tag long"), offsets.fixed)


_add("tag_closure", _closure, """WITH RECURSIVE edges AS (SELECT p_partkey AS child, p_partkey // 10 AS parent FROM part WHERE p_partkey > 0 UNION ALL SELECT * FROM (VALUES (-1, -2), (-2, -3), (-3, -1))),
c(child, tag) AS (SELECT x, x FROM (SELECT unnest([1, 2, 17, -1])::BIGINT AS x) UNION SELECT e.child, c.tag FROM c JOIN edges e ON e.parent = c.child) SELECT child, tag FROM c""")
_add("tag_bitmask", lambda s, d: tags.tag_mask(read(s, d, "lineitem").selectExpr("l_partkey + 1 AS qid", "l_linenumber AS pos"), "qid", "pos"), "SELECT l_partkey + 1 AS qid, bit_or(1::BIGINT << l_linenumber) AS tags FROM lineitem GROUP BY 1")
_add("tag_usage_top10", lambda s, d: tags.usage(read(s, d, "events").selectExpr("concat(event_type, user_id % 7) AS tag"), "tag", 10), "SELECT concat(event_type, user_id % 7) AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
_add("property_usage_top25", lambda s, d: tags.usage(read(s, d, "lineitem").selectExpr("l_partkey % 97 AS pid"), "pid", 25), "SELECT l_partkey % 97 AS pid, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, pid LIMIT 25")
_add("lang_breakdown", lambda s, d: tags.distinct_by(read(s, d, "documents"), ["source", "lang"], "doc_id"), "SELECT source, lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL")
_add("group_offsets_dense", lambda s, d: offsets.group_offsets(read(s, d, "orders").selectExpr("o_custkey + 1 AS qid"), "qid"), "WITH n AS (SELECT o_custkey + 1 AS qid, count(*) AS n FROM orders GROUP BY 1), dense AS (SELECT r.qid, coalesce(n.n, 0) AS n FROM range(1, (SELECT max(qid) + 1 FROM n)) r(qid) LEFT JOIN n USING (qid)) SELECT qid, n, (sum(n) OVER (ORDER BY qid) - n)::BIGINT AS start_index FROM dense")
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_add("payload_offsets", lambda s, d: offsets.running_sum(read(s, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("data_length")), ["doc_id"], F.col("data_length"), "data_offset"), f"SELECT doc_id, coalesce(strlen(text), 0) AS data_length, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id {_BEFORE}), 0)::BIGINT AS data_offset FROM documents")
_add("string_pool_offsets", lambda s, d: offsets.string_pool(read(s, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey") % 50).alias("title")), "title"), f"SELECT title, (1 + coalesce(sum(strlen(title) + 1) OVER (ORDER BY title {_BEFORE}), 0))::BIGINT AS pool_offset FROM (SELECT DISTINCT concat(p_name, ' ', p_partkey % 50) AS title FROM part)")


def _level(s, d):
    return offsets.sparse_level(read(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 128)


_LEVEL = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders QUALIFY row_no % 128 = 0"
_add("sparse_level_1", _level, _LEVEL)
_add("sparse_level_2", lambda s, d: offsets.sparse_level(_level(s, d).select("o_orderkey"), ["o_orderkey"], 4), f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM (SELECT o_orderkey FROM ({_LEVEL})) QUALIFY row_no % 4 = 0")
_add("sort_xid", lambda s, d: offsets.running_sum(read(s, d, "customer").select(F.concat(F.lit("Q"), "c_custkey").alias("xid")).withColumn("number", T.parse_id(F.col("xid"))), ["number"], F.lit(1).cast("long"), "place"), "SELECT concat('Q', c_custkey) AS xid, c_custkey AS number, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")


def _metadata(s, d):
    per = read(s, d, "lineitem").selectExpr("l_partkey AS qid", "concat('P', l_linenumber) AS pid", "l_orderkey").groupBy("qid", "pid").agg(F.sort_array(F.collect_list("l_orderkey")).cast("array<string>").alias("v"))
    return per.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("pid", "v"))).alias("claims")).select("qid", T.render_claims(F.col("claims")).alias("line"))


_add("metadata_render", _metadata, "SELECT qid, string_agg(concat(pid, ':', v), chr(9) ORDER BY pid) AS line FROM (SELECT l_partkey AS qid, concat('P', l_linenumber) AS pid, string_agg(l_orderkey::VARCHAR, ';;' ORDER BY l_orderkey) AS v FROM lineitem GROUP BY ALL) GROUP BY qid")
_add("claims_extract", lambda s, d: read(s, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'long')").alias("k")), "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
_QUANTITIES = (("+5.5", "+5", "+6", "http://x.example/entity/Q11573"), ("+3", None, None, "1"), ("-2e3", "-3", None, "Q7"), ("abc", "1", "2", "1"), ("", None, None, None))


def _quantities(s, d):
    q = s.createDataFrame(_QUANTITIES, "amount string, lower_bound string, upper_bound string, unit string")
    shown = T.render_quantity(F.col("amount"), F.col("lower_bound"), F.col("upper_bound"), F.col("unit"))
    return q.select("amount", shown.alias("shown")).withColumn("number", T.quantity_number(F.col("shown")))


_add("quantity_parse", _quantities, r"""SELECT amount, shown, coalesce(try_cast(trim(regexp_extract(shown, '^[^(\[]*')) AS DOUBLE), 0.0) AS number FROM (SELECT amount, concat(amount, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat('(', lo, ',', hi, ')') ELSE '' END, CASE WHEN unit <> '1' THEN concat('[', string_split(unit, '/')[-1], ']') ELSE '' END) AS shown
FROM (VALUES ('+5.5', '+5', '+6', 'http://x.example/entity/Q11573'), ('+3', NULL, NULL, '1'), ('-2e3', '-3', NULL, 'Q7'), ('abc', '1', '2', '1'), ('', NULL, NULL, NULL)) t(amount, lo, hi, unit))""")
_add("completed_anti_join", lambda s, d: dump.not_available(read(s, d, "customer").select("c_custkey", "c_name"), read(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")


def _sitelinks(s, d):
    """Titles that pages link to, with a made-up id from their length, so that some links stay unknown."""
    hrefs = links.extract_links(read(s, d, "pages"), []).select(F.substring("href", 2, 1_000).alias("title")).distinct()
    return hrefs.where("length(title) % 3 > 0").select(F.lit("en").alias("lang"), "title", F.concat(F.lit("Q"), F.length("title")).alias("qid"))


def _resolved(s, d):
    rows = links.extract_links(read(s, d, "pages"), ["page_id"]).withColumn("target", F.substring("href", 2, 1_000))
    return links.lookup(rows, _sitelinks(s, d), F.lit("en"), F.lit(""), F.col("target"))


_LINKS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS link_no FROM pages)"
_KEYS = _LINKS + ", k AS (SELECT page_id, link_no::INT AS link_no, href, trim(replace(url_decode(substring(href, 2)), '_', ' ')) AS k1 FROM l), s AS (SELECT title, concat('Q', length(title)) AS qid FROM (SELECT DISTINCT substring(href, 2) AS title FROM l) WHERE length(title) % 3 > 0)"
_LOOKUP = _KEYS + ", r AS (SELECT k.*, coalesce(a.qid, b.qid) AS qid FROM k LEFT JOIN s a ON a.title = k1 LEFT JOIN s b ON b.title = concat(upper(substring(k1, 1, 1)), substring(k1, 2)))"
_add("sitelink_lookup_fallback", lambda s, d: _resolved(s, d).select("page_id", "link_no", "href", "qid"), f"WITH {_LOOKUP} SELECT page_id, link_no, href, qid FROM r")
_add("link_resolve_q0", lambda s, d: _resolved(s, d).groupBy("page_id").agg(F.count_if(F.col("qid").isNull()).alias("unknown"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("link_no", F.coalesce("qid", F.lit("Q0")).alias("q")))), lambda x: x["q"]), " ").alias("ids")), f"WITH {_LOOKUP} SELECT page_id, count(*) FILTER (qid IS NULL) AS unknown, string_agg(coalesce(qid, 'Q0'), ' ' ORDER BY link_no) AS ids FROM r GROUP BY page_id")
_add("link_extract_classify", lambda s, d: links.extract_links(read(s, d, "pages"), ["page_id"]), f"WITH {_LINKS} SELECT page_id, link_no::INT AS link_no, href, CASE WHEN starts_with(href, '#') THEN 'fragment' WHEN regexp_matches(href, '^(https?://|//|www\\.)') THEN 'external' ELSE 'internal' END AS kind FROM l")


_add("article_envelope", lambda s, d: read(s, d, "documents").select("doc_id", T.envelope(F.concat(F.lit("Q"), "doc_id"), F.coalesce("text", F.lit(""))).alias("body")), "SELECT doc_id, concat('--- QID: Q', doc_id, ' ---', chr(10), chr(10), text, chr(10), chr(10)) AS body FROM documents")


def _lines(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM documents)"
_add("collapse_blank", lambda s, d: links.collapse_blank(_lines(s, d), "doc_id", "line_no", "line"), f"WITH {_LINES} SELECT doc_id, line_no, line FROM lines QUALIFY NOT (trim(line) = '' AND coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY line_no), false))")
_add("space_and_border_clean", lambda s, d: _lines(s, d).select("doc_id", "line_no", T.clean_line(F.concat("line", F.repeat(F.lit(" "), F.col("line_no") % 20), F.when(F.col("line") == "", F.repeat(F.lit("=-"), 60)).otherwise("."))).alias("line")), f"WITH {_LINES}, x AS (SELECT doc_id, line_no, concat(line, repeat(' ', line_no % 20), CASE WHEN line = '' THEN repeat('=-', 60) ELSE '.' END) AS line FROM lines) SELECT doc_id, line_no, regexp_replace(CASE WHEN length(line) > 100 AND regexp_full_match(line, '[-_=*+ ─│┌┬┐├┼┤└┴┘]*') THEN substring(line, 1, 80) ELSE line END, ' {{11,}}', '   ', 'g') AS line FROM x")
_add("union_payloads", lambda s, d: read(s, d, "documents").selectExpr("doc_id AS qid", "1 AS project_id", "n_chars AS data_length").unionByName(read(s, d, "orders").selectExpr("o_orderkey AS qid", "0 AS project_id", "o_custkey AS data_length")), "SELECT doc_id AS qid, 1 AS project_id, n_chars AS data_length FROM documents UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders")
_add("term_union_distinct", lambda s, d: read(s, d, "part").select(F.lower("p_name").alias("term")).union(read(s, d, "customer").select(F.lower("c_mktsegment"))).distinct(), "SELECT lower(p_name) AS term FROM part UNION SELECT lower(c_mktsegment) FROM customer")
_add("interval_merge", lambda s, d: links.merge_intervals(read(s, d, "lineitem").selectExpr("l_suppkey AS qid", "l_orderkey * 10 AS lo", "l_orderkey * 10 + l_partkey AS hi"), "qid", "lo", "hi"), f"SELECT qid, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(hi) OVER (PARTITION BY qid ORDER BY lo, hi {_BEFORE}) AS reach FROM (SELECT l_suppkey AS qid, l_orderkey * 10 AS lo, l_orderkey * 10 + l_partkey AS hi FROM lineitem))) GROUP BY qid, island")
_add("latest_per_group", lambda s, d: tags.latest(read(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url"), "host", "url"), "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, max(url) AS latest, count(*) AS n FROM pages GROUP BY 1")
