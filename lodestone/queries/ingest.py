"""Entity and article ingestion over a miniature dump whose lines are made from the part table, with SQL that never sees the lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import compression, geo, html
from ..functions import text as T
from ..operators import articles, entities, links, offsets, tags
from ..plans.settings import Settings
from ..sources import dump
from . import views as V
from .views import read

QUERIES, SQL = {}, {}
SETTINGS = Settings(
    languages=("en", "de"), concepts=("Q100", "Q101"), astro_classes=("Q102",), all_astro=True, exported_datatypes=("wikibase-item", "time", "string"),
    text_tags=("Q100", "Q103", "Q200"), date_tags=("Q103",), globe_tags=("Q200",), astro_tags=("Q102",),
)
EDGES = [("Q101", "Q200"), ("Q104", "Q103"), ("Q105", "Q106"), ("Q106", "Q200"), ("Q106", "Q105")]


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _claim(pid: str, datatype: str, value: str, rank: str = "'normal'", snak: str = "'value'") -> str:
    """SQL of one property's claims; value is SQL of its JSON."""
    return f"""concat('"{pid}":[{{"rank":"', {rank}, '","mainsnak":{{"snaktype":"', {snak}, '","datatype":"{datatype}","datavalue":{{"value":', {value}, '}}}}}}]')"""


def _amount(number: str, bounds: bool) -> str:
    sign = f"concat(if({number} < 0, '', '+'), {number})"
    more = """, '","lowerBound":"-1","upperBound":"+1","unit":"http://x.example/entity/Q9"}'""" if bounds else """, '","unit":"1"}'"""
    return f"""concat('{{"amount":"', {sign}{more})"""


_LINE = f"""CASE WHEN k % 41 = 5 THEN '{{"id": broken' ELSE concat('{{"id":"', if(k % 50 = 7, 'P', 'Q'), k + 1, '"', if(k % 50 = 7, concat(',"datatype":"', if(k % 100 = 7, 'string', 'weird'), '"'), ''),
 ',"labels":{{"en":{{"value":"', if(k % 10 = 4, '', initcap(p_name)), '"}},"de":{{"value":"', p_brand, '"}},"fr":{{"value":"non"}}}},"descriptions":{{"en":{{"value":"about ', p_name, '"}}}}',
 ',"aliases":{{"en":[{{"value":"', upper(p_name), '"}},{{"value":"', p_brand, '"}}],"fr":[{{"value":"rien"}}]}}',
 ',"sitelinks":{{"enwikiquote":{{"title":"no"}},"frwiki":{{"title":"fr"}}', if(k % 3 = 0, concat(',"enwiki":{{"title":"', p_name, ' ', k, '"}}'), ''), if(k % 5 = 0, concat(',"dewiki":{{"title":"D', k, '"}}'), ''), '}}',
 ',"claims":{{', concat_ws(',', {_claim('P31', 'wikibase-item', '''concat('{"id":"Q', 100 + p_size % 6, '"}')''', "if(k % 7 = 0, 'deprecated', 'normal')")},
 if(k % 4 = 0, {_claim('P625', 'globe-coordinate', '''concat('{"latitude":', k % 160 - 80, ',"longitude":', k * 7 % 360 - 180, '}')''')}, null),
 if(k % 6 = 0, {_claim('P571', 'time', '''concat('{"time":"+', 1900 + p_size, '-', lpad(1 + k % 12, 2, '0'), '-', lpad(1 + k % 28, 2, '0'), 'T00:00:00Z"}')''', "if(k % 12 = 0, 'deprecated', 'preferred')")}, null),
 if(k % 8 = 0, concat_ws(',', {_claim('P1457', 'quantity', _amount('k % 10', False))}, {_claim('P6257', 'quantity', _amount('k % 360', True))}, {_claim('P6258', 'quantity', _amount('(k % 180 - 90)', True))}), null),
 if(k % 2 = 1, {_claim('P1', 'string', '''concat('"v ', k, '"')''', snak="if(k % 11 = 0, 'novalue', 'value')")}, null)), '}}}}', if(k % 3 = 1, ',', '')) END"""
_PARTS = """p AS (SELECT p_partkey AS k, p_name, p_brand, p_size, 100 + p_size % 6 AS class, p_partkey % 41 = 5 AS broken, p_partkey % 41 <> 5 AND p_partkey % 50 <> 7 AS item, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS has_article FROM part),
f AS (SELECT *, class IN (100, 101) AS concept, item AND (has_article OR class IN (100, 101)) AS in_text, item AND has_article AND k % 4 = 0 AS in_globe, item AND k % 12 = 6 AS in_date, item AND class = 102 AND k % 8 = 0 AND k % 10 <= 6.5 AS in_astro, NOT broken AND k % 100 = 7 AS used_property FROM p),
e AS (SELECT *, in_text OR in_globe OR in_date OR in_astro AS used, CASE class WHEN 100 THEN 1 WHEN 101 THEN 4 WHEN 103 THEN 2 WHEN 104 THEN 2 WHEN 105 THEN 4 ELSE 0 END AS text_mask, CASE WHEN class IN (101, 105) THEN 1 ELSE 0 END AS globe_mask, CASE WHEN class IN (103, 104) THEN 1 ELSE 0 END AS date_mask FROM f)"""


def lines(s, d):
    """The dump: brackets, entities, some broken lines. A part's row is a fraction of its line, so rows are dealt to all cores before they become lines."""
    own = read(s, d, "part").repartition(3 * s.sparkContext.defaultParallelism, "p_partkey").selectExpr("p_partkey AS k", "*").selectExpr(f"{_LINE} AS value")
    return own.union(s.createDataFrame([("[",), ("]",)], "value string"))


def _described(s, d):
    return entities.describe(entities.parse_lines(lines(s, d)), SETTINGS)


def _dictionary(s):
    edges = s.createDataFrame(EDGES, "child string, parent string")
    return tags.subclass_closure(edges, s.createDataFrame([(t,) for t in SETTINGS.all_tags()], "tag string"), offsets.fixed)


def _routed(name):
    return lambda s, d: entities.route(_described(s, d), _dictionary(s), SETTINGS)[name]


_INDEXES = ("text", "globe", "date", "astro")
_COUNTS = ", ".join(f"count(*) FILTER (in_{i}) AS {i}_used, count(*) FILTER (in_{i} AND has_article) AS {i}_with_article, count(*) FILTER (in_{i} AND NOT has_article) AS {i}_without_article" for i in _INDEXES)
_METRICS = f"SELECT count(*) AS lines_read, count(*) FILTER (item) AS items, count(*) FILTER (NOT broken AND NOT item) AS properties, count(*) FILTER (used) AS items_used, count(*) FILTER (used_property) AS properties_used, count(*) FILTER (NOT used AND NOT used_property) AS lines_skipped, {_COUNTS} FROM e"
_add("parse_metrics", lambda s, d: entities.metrics(_described(s, d)), f"WITH {_PARTS} {_METRICS}")


def _checks(s, d):
    described = _described(s, d)
    return entities.sanity_checks(entities.metrics(described), entities.metadata(described.where("used"), SETTINGS))


_add("parse_sanity_checks", _checks, f"WITH {_PARTS}, m AS ({_METRICS}) SELECT (SELECT count(*) FROM e WHERE used) = items_used AS metadata_adds_up, {', '.join(f'{i}_with_article + {i}_without_article = {i}_used AS {i}_adds_up' for i in _INDEXES)}, items_used + properties_used + lines_skipped = lines_read AS lines_add_up FROM m")
_add("index_admission", lambda s, d: _described(s, d).where("kind = 'item'").select("id", "has_article", "concept", *[f"in_{i}" for i in _INDEXES]), f"WITH {_PARTS} SELECT concat('Q', k + 1) AS id, has_article, concept, in_text, in_globe, in_date, in_astro FROM e WHERE item")
_add("used_anywhere", lambda s, d: _described(s, d).where("used or used_property").select("id"), f"WITH {_PARTS} SELECT concat(CASE WHEN used THEN 'Q' ELSE 'P' END, k + 1) AS id FROM e WHERE used OR used_property")
_add("dump_broken_lines", lambda s, d: entities.parse_lines(lines(s, d)).where("id is null").select("line"), f"WITH {_PARTS} SELECT '{{\"id\": broken' AS line FROM e WHERE broken")
_add("entity_route", _routed("omni_terms"), f"WITH {_PARTS} SELECT DISTINCT term, k + 1 AS qid, text_mask::BIGINT AS tags FROM (SELECT *, unnest([lower(p_name), lower(p_brand)]) AS term FROM e WHERE in_text)")
_add("entity_route_globe", lambda s, d: _routed("globe_terms")(s, d).drop("morton"), f"WITH {_PARTS} SELECT (k % 160 - 80)::DOUBLE AS lat, (k * 7 % 360 - 180)::DOUBLE AS lon, k + 1 AS qid, globe_mask::BIGINT AS tags FROM e WHERE in_globe")
_add("entity_route_dates", _routed("temporal_terms"), f"WITH {_PARTS} SELECT ((1900 + p_size) * 10000 + (1 + k % 12) * 100 + 1 + k % 28)::BIGINT AS date_code, k + 1 AS qid, 'P571' AS pid, date_mask::BIGINT AS tags FROM e WHERE in_date")
_add("entity_route_astro", lambda s, d: _routed("astro_terms")(s, d).drop("morton"), f"WITH {_PARTS} SELECT (k % 180 - 90)::DOUBLE AS lat, (k % 360)::DOUBLE AS lon, k + 1 AS qid, 1::BIGINT AS tags FROM e WHERE in_astro")
_SITELINKS = "SELECT 'en' AS lang, concat(p_name, ' ', k) AS title, concat('Q', k + 1) AS qid FROM e WHERE used AND k % 3 = 0 UNION ALL SELECT 'de', concat('D', k), concat('Q', k + 1) FROM e WHERE used AND k % 5 = 0"
_add("sitelink_filter", _routed("sitelinks"), f"WITH {_PARTS} {_SITELINKS}")
_CLAIMS = "concat_ws(chr(9), CASE WHEN k % 2 = 1 AND k % 11 <> 0 THEN concat('P1:v ', k) END, CASE WHEN k % 7 <> 0 THEN concat('P31:Q', class) END, CASE WHEN k % 12 = 6 THEN concat('P571:+', 1900 + p_size, '-', lpad((1 + k % 12)::VARCHAR, 2, '0'), '-', lpad((1 + k % 28)::VARCHAR, 2, '0'), 'T00:00:00Z') END)"
_add("entity_metadata", lambda s, d: _routed("metadata")(s, d).select("qid", "body"), f"WITH {_PARTS} SELECT k + 1 AS qid, {_CLAIMS} AS body FROM e WHERE used")
_PROPERTIES = "SELECT k + 1 AS pid, l.lang, CASE WHEN l.lang = 'en' THEN concat(upper(substring(p_name, 1, 1)), substring(p_name, 2)) ELSE p_brand END AS label, CASE WHEN l.lang = 'en' THEN concat('about ', p_name) ELSE '' END AS description, 'string' AS datatype FROM e, (VALUES ('en'), ('de')) l(lang) WHERE used_property AND (l.lang = 'de' OR k % 10 <> 4)"
_add("property_admission", lambda s, d: entities.property_rows(_described(s, d)).withColumn("label", F.lower("label")), f"WITH {_PARTS} SELECT pid, lang, lower(label) AS label, description, datatype FROM ({_PROPERTIES})")
_add("dump_property_usage", lambda s, d: entities.property_usage(_described(s, d), SETTINGS), f"WITH {_PARTS} SELECT * FROM (SELECT 'P1' AS pid, count(*) FILTER (k % 2 = 1 AND k % 11 <> 0) AS n FROM e WHERE item UNION ALL SELECT 'P31', count(*) FILTER (k % 7 <> 0) FROM e WHERE item UNION ALL SELECT 'P571', count(*) FILTER (k % 12 = 6) FROM e WHERE item) WHERE n > 0")
_add("dump_tag_usage", lambda s, d: entities.tag_usage(_described(s, d), _dictionary(s), "text", SETTINGS.text_tags), f"WITH {_PARTS} SELECT CASE text_mask WHEN 1 THEN 'Q100' WHEN 2 THEN 'Q103' ELSE 'Q200' END AS tag, count(*) AS n FROM e WHERE in_text AND text_mask > 0 GROUP BY 1")
_add("dump_lang_breakdown", lambda s, d: entities.lang_breakdown(_described(s, d)), f"WITH {_PARTS} " + " UNION ALL ".join(f"SELECT '{i}' AS index, '{lang}' AS lang, count(*) AS n FROM e WHERE in_{i} AND k % {m} = 0 GROUP BY 1, 2" for i in _INDEXES for lang, m in (("en", 3), ("de", 5))))
_add("tag_join", lambda s, d: tags.tag_entities(_described(s, d).where("used").select(T.parse_id(F.col("id")).alias("qid"), F.explode("classes").alias("class_qid")), _dictionary(s)).select("qid", F.array_join("tags", ",").alias("tags")), f"WITH {_PARTS} SELECT k + 1 AS qid, CASE class WHEN 100 THEN 'Q100' WHEN 101 THEN 'Q200' WHEN 102 THEN 'Q102' WHEN 103 THEN 'Q103' WHEN 104 THEN 'Q103' ELSE 'Q200' END AS tags FROM e WHERE used")
_add("tag_dictionary_counts", lambda s, d: _dictionary(s).groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (VALUES ('Q100', 1), ('Q102', 1), ('Q103', 2), ('Q200', 4)) t(tag, n)")
_add("union_vocabularies", lambda s, d: entities.union_vocabularies(read(s, d, "part").select("p_type"), read(s, d, "part").select("p_brand"), read(s, d, "customer").select("c_mktsegment")), "SELECT p_type AS tag FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment FROM customer")
_VALUES = [
    ("string", "as is", "as is"), ("url", "http://a.example/", "http://a.example/"), ("wikibase-property", '{"id":"P7"}', "P7"), ("wikibase-item", '{"numeric-id":7}', None),
    ("time", '{"time":"-0500-01-01T00:00:00Z"}', "-0500-01-01T00:00:00Z"), ("quantity", '{"amount":"+5.5","lowerBound":"+5","upperBound":"+6","unit":"http://x.example/entity/Q11573"}', "+5.5(+5,+6)[Q11573]"),
    ("quantity", '{"amount":"+3","unit":"1"}', "+3"), ("quantity", '{"amount":"-2","lowerBound":"-3"}', "-2"), ("quantity", '{"unit":"1"}', None),
    ("monolingualtext", '{"text":"Haus","language":"de"}', "Haus@de"), ("monolingualtext", '{"text":"maison","language":"fr"}', None), ("globe-coordinate", '{"latitude":48.8584,"longitude":-2.5}', "48.8584,-2.5"),
    ("globe-coordinate", '{"latitude":48.8584}', None), ("other", "x", None),
]
_quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _table(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + ")"


_add("claim_values", lambda s, d: s.createDataFrame(_VALUES, "datatype string, value string, expected string").select("datatype", "value", entities.render_value(F.col("datatype"), F.col("value"), ("en", "de")).alias("shown")), f"SELECT * FROM {_table(_VALUES)} t(datatype, value, shown)")

# articles

GOLDENS = [
    ("formula", '<div class="mw-parser-output"><p>The famous equation <span class="mwe-math-element"><math><semantics><annotation encoding="application/x-tex">{\\displaystyle E=mc^2}</annotation></semantics></math></span> changed physics.</p></div>', "The famous equation $E=mc^2$ changed physics."),
    ("link", '<p><a href="Albert_Einstein" title="Albert Einstein">Albert Einstein</a> was a theoretical physicist.</p>', "Albert Einstein [Q0] was a theoretical physicist."),
    ("table", '<p>Here is some data:</p><table class="wikitable"><tr><th>Column A</th><th>Column B | Data</th></tr><tr><td>Row 1</td><td>Value 1</td></tr></table>', "Here is some data:\n\n[[TABLE_START]]\nH|Column A|Column B ¦ Data\nR|Row 1|Value 1\n[[TABLE_END]]"),
    ("junk", '<style>.x{}</style><div class="navbox">Nav</div><p>This is the only valid text.<sup class="reference">[1]</sup></p><table class="infobox"><tr><td>x</td></tr></table>', "This is the only valid text."),
    ("sections", "<h2>History</h2><p>This is good content.</p><h2>References</h2><p>Drop this.</p><h2>External links</h2><ul><li>and this</li></ul>", "## History\n\nThis is good content."),
    ("spacing", "<pre>Column A" + " " * 3 + "Column B</pre>", "Column A Column B"),
]
_add("article_clean", lambda s, d: html.html_to_text(s.createDataFrame([g[:2] for g in GOLDENS], "name string, html string"), ["name"]).select("name", "body"), f"SELECT * FROM {_table([(g[0], g[2]) for g in GOLDENS])} t(name, body)")


def _odd(text):
    """A stand-in for the cleaner that fails on some pages."""
    if len(text) % 5 == 0:
        raise ValueError(f"{len(text)} characters")
    return text, [], []


def _split(good):
    def run(s, d):
        pages = read(s, d, "pages").select("page_id", "html")
        found = articles.split_anomalies(html.html_to_text(pages, ["page_id"], process=_odd), pages, ["page_id"])
        return found[0].select("page_id", "body") if good else found[1]

    return run


_add("anomaly_split", _split(False), "SELECT page_id, concat('ValueError: ', length(html), ' characters') AS error_msg, html AS raw_content FROM pages WHERE length(html) % 5 = 0")
_add("anomaly_split_rest", _split(True), "SELECT page_id, html AS body FROM pages WHERE length(html) % 5 <> 0")
_HEADED = "SELECT doc_id, line_no, CASE WHEN line_no % 9 = 2 THEN '## Notes and more' WHEN line_no % 9 = 4 THEN '### Part' WHEN line_no % 9 = 5 THEN '## History' WHEN line_no % 9 = 7 THEN ' ' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM documents)"


def _headed(s, d):
    own = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return own.selectExpr("doc_id", "line_no", "CASE WHEN line_no % 9 = 2 THEN '## Notes and more' WHEN line_no % 9 = 4 THEN '### Part' WHEN line_no % 9 = 5 THEN '## History' WHEN line_no % 9 = 7 THEN ' ' ELSE line END AS line")


_UNWANTED = " OR ".join(f"starts_with(trim(line), '{h}')" for h in T.UNWANTED_SECTIONS)
_DROPPED = f"SELECT doc_id, line_no, line FROM (SELECT *, last_value(CASE WHEN starts_with(trim(line), '#') THEN {_UNWANTED} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS gone FROM {{}}) WHERE gone IS NOT TRUE"
_KINDS = "SELECT doc_id, line_no, line FROM (SELECT *, first_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM (SELECT *, CASE WHEN starts_with(trim(line), '#') THEN 'heading' WHEN trim(line) <> '' THEN 'text' END AS kind FROM {})) WHERE kind IS DISTINCT FROM 'heading' OR following = 'text'"
_add("drop_sections", lambda s, d: articles.drop_sections(_headed(s, d), "doc_id", "line_no", "line"), _DROPPED.format(f"({_HEADED})"))
_add("heading_has_content", lambda s, d: articles.drop_empty_headings(_headed(s, d), "doc_id", "line_no", "line"), _KINDS.format(f"({_HEADED})"))
_BORDERED = "regexp_replace(CASE WHEN length(line) > 100 AND regexp_full_match(line, '[-_=*+ ─│┌┬┐├┼┤└┴┘]*') THEN substring(line, 1, 80) ELSE line END, ' {11,}', '   ', 'g')"
_add("normalize_lines", lambda s, d: articles.normalise_lines(_headed(s, d), "doc_id", "line_no", "line"), f"WITH h AS ({_HEADED}), a AS ({_DROPPED.format('h')}), b AS ({_KINDS.format('a')}), c AS (SELECT * FROM b QUALIFY NOT (trim(line) = '' AND coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY line_no), false))) SELECT doc_id, line_no, {_BORDERED} AS line FROM c")
_PAGES = "page_id, 'en' AS lang, concat('T', page_id % 40) AS title, url, CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'I' ELSE 'A' END AS namespace, page_id % 4 = 3 AS is_redirect"


def _archive(s, d):
    return read(s, d, "pages").selectExpr("page_id", "'en' AS lang", "concat('T', page_id % 40) AS title", "url", "CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'I' ELSE 'A' END AS namespace", "page_id % 4 = 3 AS is_redirect")


def _known(s):
    return s.createDataFrame([("en", f"T{i}", f"Q{i}") for i in range(0, 40, 8)], "lang string, title string, qid string")


_add("namespace_redirect_filter", lambda s, d: articles.article_pages(_archive(s, d)).select("page_id", "namespace"), f"SELECT page_id, namespace FROM (SELECT {_PAGES} FROM pages) WHERE namespace IN ('A', 'C') AND NOT is_redirect")
_add("qid_resolved", lambda s, d: articles.resolve_pages(_archive(s, d), _known(s))[0].select("page_id", "qid"), "SELECT page_id, concat('Q', page_id % 40) AS qid FROM pages WHERE page_id % 40 % 8 = 0")
_add("qid_unresolved", lambda s, d: articles.resolve_pages(_archive(s, d), _known(s))[1].select("page_id"), "SELECT page_id FROM pages WHERE page_id % 40 % 8 <> 0")


def _article_metrics(s, d):
    found, missing = articles.resolve_pages(_archive(s, d), _known(s))
    return articles.article_metrics(found.where("page_id % 3 > 0"), missing, found.where("page_id % 3 = 0"))


_add("article_metrics", _article_metrics, "SELECT 'en' AS lang, count(*) FILTER (hit AND page_id % 3 > 0) AS processed, count(*) FILTER (NOT hit) AS skipped, count(*) FILTER (hit AND page_id % 3 = 0) AS failed, count(*) AS total, round(100 * processed / total, 3) AS percent FROM (SELECT *, page_id % 40 % 8 = 0 AS hit FROM pages)")
_add("sample_titles", lambda s, d: articles.sample_titles(_archive(s, d), ["t3", "T7", "none"]).select("page_id"), "SELECT page_id FROM pages WHERE page_id % 40 IN (3, 7)")


def _store(s, d):
    return articles.content_store(read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body")), ["doc_id"])


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_add("content_store", lambda s, d: _store(s, d).drop("body"), f"SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS data_length, coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id {_BEFORE}), 0)::BIGINT AS data_offset FROM documents")
_add("payload_region", lambda s, d: articles.read_payload(_store(s, d), 1_000, 5_000, 512).select("chunk", F.hex("bytes").alias("bytes")), "SELECT i::BIGINT AS chunk, substring(h, (2001 + i * 1024)::INT, (2 * least(512, 5000 - i * 512))::INT) AS bytes FROM (SELECT string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY doc_id) AS h FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 400)), range(0, 10) r(i)")
_ROWS = "SELECT doc_id AS qid, 1 AS project_id, n_chars AS data_length FROM documents UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders"


def _rows(s, d):
    return read(s, d, "documents").selectExpr("doc_id AS qid", "1 AS project_id", "n_chars AS data_length").unionByName(read(s, d, "orders").selectExpr("o_orderkey AS qid", "0 AS project_id", "o_custkey AS data_length"))


_add("absolute_offset", lambda s, d: _rows(s, d).select("qid", "project_id", articles.absolute_offset(F.col("project_id"), F.col("data_length"), 4_096, 1_000_000).alias("place")), f"SELECT qid, project_id, CASE WHEN project_id = 0 THEN 4096 ELSE 1000000 END + data_length AS place FROM ({_ROWS})")
_add("metadata_index", lambda s, d: offsets.running_sum(_rows(s, d), ["project_id", "qid"], F.col("data_length"), "data_offset"), f"SELECT *, coalesce(sum(data_length) OVER (ORDER BY project_id, qid {_BEFORE}), 0)::BIGINT AS data_offset FROM ({_ROWS})")


def _property_index(s, d):
    named = entities.property_rows(_described(s, d)).join(s.createDataFrame([(1, "en"), (2, "de")], "project_id int, lang string"), "lang")
    named = offsets.fixed(named.select("pid", "project_id"))  # read four times
    return offsets.group_offsets(named.select("pid"), "pid").where("n > 0").join(named.select("pid", "project_id"), "pid")


_add("property_index", _property_index, f"WITH {_PARTS}, r AS ({_PROPERTIES}), n AS (SELECT pid, count(*) AS n FROM r GROUP BY pid) SELECT pid, n, (sum(n) OVER (ORDER BY pid) - n)::BIGINT AS start_index, j AS project_id FROM n, (VALUES (1), (2)) x(j) WHERE EXISTS (SELECT 1 FROM r WHERE r.pid = n.pid AND r.lang = CASE j WHEN 1 THEN 'en' ELSE 'de' END) QUALIFY true".replace("(sum(n) OVER (ORDER BY pid) - n)::BIGINT AS start_index", "(SELECT coalesce(sum(m.n), 0) FROM n m WHERE m.pid < n.pid)::BIGINT AS start_index").replace(" QUALIFY true", ""))
_add("kv_build", lambda s, d: links.sitelink_table(read(s, d, "customer").selectExpr("'en' AS lang", "concat('T', c_custkey % 50) AS title", "concat('Q', c_custkey) AS qid")), "SELECT 'en' AS lang, concat('T', c_custkey % 50) AS title, min(concat('Q', c_custkey)) AS qid FROM customer GROUP BY 2")

# compression, terms, sorts, samples, sources


def _packed(s, d):
    docs = read(s, d, "documents").select("doc_id", "lang", "text")
    sized = docs.where("text is not null").select("doc_id", "text", F.octet_length("text").alias("size"))
    dictionary = compression.train_dictionary(offsets.byte_sample(sized, "size", ["doc_id"], 500_000), "text")
    return compression.compress(docs, "text", "packed", dictionary), dictionary


def _round_trip(s, d):
    packed, dictionary = _packed(s, d)
    return compression.decompress(packed.drop("text"), "packed", "body", dictionary).select("doc_id", F.octet_length("body").cast("long").alias("raw_bytes"), F.sha2("body", 256).alias("sha"))


_add("compress_round_trip", _round_trip, "SELECT doc_id, strlen(text) AS raw_bytes, sha256(text) AS sha FROM documents")
_add("compression_report", lambda s, d: compression.ratio_report(_packed(s, d)[0].where("text is not null"), F.octet_length("text"), F.length("packed"), "lang"))
_add("compression_stats", lambda s, d: compression.ratio_report(read(s, d, "documents").where("text is not null"), F.octet_length("text"), F.col("n_chars"), "lang"), "SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS raw_bytes, sum(n_chars)::BIGINT AS packed_bytes, round(sum(n_chars) / sum(strlen(text)), 6) AS bulk_ratio, round(avg(r), 6) AS mean_ratio, round(stddev_pop(r), 6) AS deviation, round(min(r), 6) AS least, round(max(r), 6) AS most FROM (SELECT *, CASE WHEN strlen(text) > 0 THEN n_chars / strlen(text) END AS r FROM documents WHERE text IS NOT NULL) GROUP BY lang")
_add("term_bytes", lambda s, d: read(s, d, "documents").select("doc_id", F.hex(T.term_bytes(F.lower("text"))).alias("term")), "SELECT doc_id, substring(hex(encode(lower(text))), 1, 112) AS term FROM documents")
_add("strip_control", lambda s, d: read(s, d, "documents").select("doc_id", T.strip_control(F.col("text")).alias("line")), r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g') AS line FROM documents")
_add("haversine", lambda s, d: V.customer_globe(s, d).select("qid", F.round(geo.haversine(F.col("lat"), F.col("lon"), 48.8584, 2.2945), 3).alias("km")), V.with_views("customer_globe") + f" SELECT qid, round(2 * {geo.EARTH.radius!r} * asin(least(1.0, sqrt(pow(sin(radians(lat - 48.8584) / 2), 2) + cos(radians(lat)) * cos(radians(48.8584)) * pow(sin(radians(lon - 2.2945) / 2), 2)))), 3) AS km FROM customer_globe")
_add("sort_alphabetical", lambda s, d: offsets.sort_alphabetical(read(s, d, "customer").select("c_name", "c_custkey"), "c_name"), "SELECT c_name, c_custkey FROM customer ORDER BY c_name")
_add("sort_numeric", lambda s, d: offsets.sort_numeric(read(s, d, "customer").select(F.col("c_acctbal").cast("string").alias("balance"), "c_custkey"), "balance").select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_acctbal")
_add("weighted_sample", lambda s, d: offsets.byte_sample(read(s, d, "documents").select("doc_id", F.col("n_chars").alias("size")), "size", ["doc_id"], 100_000), "SELECT doc_id, size FROM (SELECT doc_id, n_chars AS size, coalesce(sum(n_chars) OVER (ORDER BY md5(concat('42|', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 100000")
_add("line_limit", lambda s, d: lines(s, d).limit(50).agg(F.count(F.lit(1)).alias("n")), "SELECT 50 AS n")
_add("listing_latest", lambda s, d: dump.latest_files(dump.listed_files(read(s, d, "pages"), F.col("html"), "^/([a-z])")), r"""SELECT regexp_extract(href, '^/([a-z])', 1) AS lang, max(href) AS href FROM (SELECT unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/([a-z])') GROUP BY 1""")


def _delimited(s, d):
    """Rows of nation as text, with one line of too few fields, and back."""
    folder = s.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="lodestone-")
    path = f"{folder}/lines-{uuid.uuid4().hex}"
    read(s, d, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value")).union(s.createDataFrame([("1\tx",)], "value string")).write.text(path)
    return dump.delimited(s, path, "n_nationkey int, n_name string, n_regionkey int")


_add("tsv_scan", _delimited, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
