"""Entity ingestion: dump lines to entities, and entities to the relations they take part in.

Everything about one entity is in its own row, so claims, terms, tags and admission are array expressions without a shuffle; only
the tag closure is joined. route() gives each relation as a projection of the same parsed rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..functions import text as T
from ..plans.settings import Settings

#: Datatypes by how their values are written. Fixed values.
PLAIN = ("string", "external-id", "commonsMedia", "url", "math", "musical-notation", "geo-shape", "tabular-data")
REFERENCES = ("wikibase-item", "wikibase-property", "wikibase-lexeme", "wikibase-form", "wikibase-sense")
ENTITY = (
    "id string, datatype string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, "
    "sitelinks map<string,struct<title:string>>, claims map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datatype:string,datavalue:struct<value:string>>>>>"
)
SHORTEST_LINE = 5
INDEXES = ("text", "globe", "date", "astro")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row for each line that may hold an entity: line, and the fields of ENTITY, all null where the line is broken.

    Lines under five characters (brackets of the array) are no entities; a comma at the end goes. The fields come out of a generator, which
    Catalyst neither copies into what reads them nor pushes conditions through: each line is parsed once.
    """
    clean = F.regexp_replace(F.trim(F.col(column)), ",$", "")
    rows = lines.where(F.length(F.col(column)) >= SHORTEST_LINE).select(clean.alias("line"))
    return rows.select("line", F.inline(F.array(F.from_json("line", ENTITY))))


def render_value(datatype: Column, value: Column, languages: tuple[str, ...]) -> Column:
    """A claim's value as text, by datatype; null where there is none."""
    at = lambda path: F.get_json_object(value, path)
    spoken = at("$.language").isin(list(languages)) if languages else F.lit(False)
    unit = F.coalesce(at("$.unit"), F.lit("1"))
    quantity = F.when(F.element_at(F.split(unit, "/"), -1) == "1", T.render_quantity(at("$.amount"), at("$.lowerBound"), at("$.upperBound"), F.lit("1"))).otherwise(T.render_quantity(at("$.amount"), at("$.lowerBound"), at("$.upperBound"), unit))
    return (
        F.when(datatype.isin(*PLAIN), value)
        .when(datatype.isin(*REFERENCES), at("$.id"))
        .when(datatype == "time", at("$.time"))
        .when(datatype == "quantity", quantity)
        .when((datatype == "monolingualtext") & spoken, F.concat(at("$.text"), F.lit("@"), at("$.language")))
        .when(datatype == "globe-coordinate", F.concat(at("$.latitude"), F.lit(","), at("$.longitude")))
    )


def _usable(claim: Column) -> Column:
    return (F.coalesce(claim["rank"], F.lit("")) != "deprecated") & (claim["mainsnak"]["snaktype"] == "value")


def claim_values(claims: Column, languages: tuple[str, ...], datatypes: tuple[str, ...] | None = None) -> Column:
    """Values as text of an array of claims, in order: neither deprecated nor without value, and of the datatypes given."""
    own = lambda c: _usable(c) & (c["mainsnak"]["datatype"].isin(*datatypes) if datatypes is not None else F.lit(True))
    shown = F.transform(F.filter(claims, own), lambda c: render_value(c["mainsnak"]["datatype"], c["mainsnak"]["datavalue"]["value"], languages))
    return F.filter(F.coalesce(shown, F.array().cast("array<string>")), lambda v: v.isNotNull())


def last_quantity(claims: Column, languages: tuple[str, ...]) -> Column:
    """The same for index use, where of several quantities only the last counts."""
    values = claim_values(claims, languages)
    numeric = F.exists(F.filter(claims, _usable), lambda c: c["mainsnak"]["datatype"] == "quantity")
    return F.when(F.coalesce(numeric, F.lit(False)), F.slice(values, -1, 1)).otherwise(values)


def direct_classes(claims: Column) -> Column:
    """Ids of the classes an entity is stated to be an instance of, whatever the rank."""
    ids = F.transform(claims, lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda v: v.isNotNull())


def relevant_sitelinks(sitelinks: Column, languages: tuple[str, ...]) -> Column:
    """lang and title of the sitelinks of the languages given."""
    entries = F.filter(F.map_entries(sitelinks), lambda e: e["key"].endswith("wiki") & F.regexp_replace(e["key"], "wiki$", "").isin(*languages))
    pairs = F.transform(entries, lambda e: F.struct(F.regexp_replace(e["key"], "wiki$", "").alias("lang"), e["value"]["title"].alias("title")))
    return F.coalesce(pairs, F.array().cast("array<struct<lang:string,title:string>>"))


def search_terms(labels: Column, aliases: Column, languages: tuple[str, ...], case_sensitive: bool = False) -> Column:
    """Distinct labels and aliases that are not empty, made lower case first unless case counts."""
    own = lambda m, empty: F.filter(F.coalesce(F.map_entries(m), F.array().cast(empty)), lambda e: e["key"].isin(*languages))
    names = F.transform(own(labels, "array<struct<key:string,value:struct<value:string>>>"), lambda e: e["value"]["value"])
    more = F.flatten(F.transform(own(aliases, "array<struct<key:string,value:array<struct<value:string>>>>"), lambda e: F.transform(e["value"], lambda a: a["value"])))
    both = F.filter(F.concat(names, F.coalesce(more, F.array().cast("array<string>"))), lambda t: F.coalesce(F.length(t), F.lit(0)) > 0)
    return F.array_distinct(both if case_sensitive else F.transform(both, F.lower))


def describe(parsed: DataFrame, s: Settings) -> DataFrame:
    """One row for each parsed line with what routing asks for: kind ('item', 'property' or null), flags, values, and in which indexes it is.

    As in parse_lines() a generator gives the columns, so that conditions on them don't evaluate all they depend on again.
    """
    claims = lambda pid: F.col("claims")[pid]
    none = F.lit(False)
    rows = parsed.withColumn("kind", F.when(F.col("id").startswith("Q"), "item").when(F.col("id").startswith("P"), "property"))
    rows = rows.withColumn("own_links", relevant_sitelinks(F.col("sitelinks"), s.languages)).withColumn("classes", direct_classes(claims(s.class_property)))
    rows = rows.withColumn("has_article", F.size("own_links") > 0).withColumn("own_links", F.filter("own_links", lambda x: x["title"].isNotNull()))
    listed = lambda names: F.arrays_overlap("classes", F.array(*map(F.lit, names))) if names else none
    rows = rows.withColumn("concept", F.coalesce(listed(s.concepts), none)).withColumn("is_astro", F.coalesce(listed(s.astro_classes), none))
    rows = rows.withColumn("terms", search_terms(F.col("labels"), F.col("aliases"), s.languages, s.case_sensitive))
    coordinate = r"^\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?),(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)$"
    positions = F.transform(F.filter(claim_values(claims(s.globe_property), s.languages), lambda v: v.rlike(coordinate)), lambda v: F.struct(F.regexp_extract(v, coordinate, 1).cast("double").alias("lat"), F.regexp_extract(v, coordinate, 2).cast("double").alias("lon")))
    rows = rows.withColumn("positions", positions)
    stated = lambda pid: F.transform(claim_values(claims(pid), s.languages), lambda v: F.struct(F.lit(pid).alias("pid"), v.alias("time")))
    rows = rows.withColumn("dates", F.concat(*map(stated, s.date_properties)))
    number = lambda pid: F.transform(last_quantity(claims(pid), s.languages), T.quantity_number)
    rows = rows.withColumn("magnitudes", number(s.magnitude_property)).withColumn("ra", F.get(number(s.ascension_property), F.lit(0))).withColumn("dec", F.get(number(s.declination_property), F.lit(0)))
    bright = ~F.exists("magnitudes", lambda m: m > s.most_magnitude)
    linked = lambda every: F.lit(True) if every else F.col("has_article")
    item = F.coalesce(F.col("kind") == "item", none)
    rows = rows.withColumn("in_text", item & F.lit(s.text_index) & (F.col("has_article") | F.col("concept")) & (F.size("terms") > 0))
    rows = rows.withColumn("in_globe", item & F.lit(s.globe_index) & linked(s.all_globe) & (F.size("positions") > 0))
    rows = rows.withColumn("in_date", item & F.lit(s.date_index) & linked(s.all_dates) & (F.size("dates") > 0))
    placed = F.col("ra").isNotNull() & F.col("dec").isNotNull()  # a star without a place is not put at (0, 0)
    rows = rows.withColumn("in_astro", item & F.lit(s.astro_index) & F.col("is_astro") & linked(s.all_astro) & bright & placed)
    rows = rows.withColumn("used", F.col("in_text") | F.col("in_globe") | F.col("in_date") | F.col("in_astro"))
    named = F.filter(F.coalesce(F.map_entries("labels"), F.array().cast("array<struct<key:string,value:struct<value:string>>>")), lambda e: e["key"].isin(*s.languages) & (F.coalesce(F.length(e["value"]["value"]), F.lit(0)) > 0))
    rows = rows.withColumn("own_labels", named)
    exported = F.col("datatype").isin(*s.exported_datatypes) if s.exported_datatypes else none
    rows = rows.withColumn("used_property", F.coalesce((F.col("kind") == "property") & exported & (F.size("own_labels") > 0), none))
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def class_tags(described: DataFrame, closure: DataFrame, vocabularies: dict[str, tuple[str, ...]]) -> DataFrame:
    """id and, for each index, the mask of its tags that the classes of an entity reach; closure has child and tag.

    Only (class, tag) pairs of the vocabularies are joined, once for all indexes; classes of an entity meet by id after a map-side OR.
    """
    from .tags import bit

    for tags in vocabularies.values():
        if len(tags) > 32:
            raise ValueError("over 32 tags")
    own = closure.where(F.col("tag").isin(sorted({t for v in vocabularies.values() for t in v})))
    pairs = described.where("used").select("id", F.explode_outer("classes").alias("child")).join(own, "child", "left")
    place = lambda tags: F.array_position(F.array(*map(F.lit, tags)), F.col("tag")).cast("int") - 1
    mask = lambda tags: F.coalesce(F.bit_or(F.when(F.col("tag").isin(*tags), bit(place(tags)))), F.lit(0)) if tags else F.first(F.lit(0))
    return pairs.groupBy("id").agg(*[mask(tags).cast("long").alias(f"{i}_mask") for i, tags in vocabularies.items()])


def route(described: DataFrame, closure: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The relations of a dump by name: omni_terms, globe_terms, temporal_terms, astro_terms, sitelinks, metadata and property_rows.

    Entities that no index has give nothing at all. Dates that can't be read are dropped from the index. The caller should persist
    or write `described` first: every relation is a projection of it.
    """
    masks = class_tags(described, closure, dict(zip(INDEXES, (s.text_tags, s.globe_tags, s.date_tags, s.astro_tags))))
    own = described.where("used")
    used = own.join(masks, "id")
    qid = T.parse_id(F.col("id")).alias("qid")
    tagged = lambda i: F.col(f"{i}_mask").alias("tags")
    globe = used.where("in_globe").select("id", "globe_mask", F.explode("positions").alias("p")).select(F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), qid, tagged("globe"))
    times = used.where("in_date").select("id", "date_mask", F.explode("dates").alias("d")).select(dates.encode_date(F.col("d.time")).alias("date_code"), qid, F.col("d.pid").alias("pid"), tagged("date"))
    astro = used.where("in_astro").select(F.col("dec").alias("lat"), F.col("ra").alias("lon"), qid, tagged("astro"))
    return {
        "omni_terms": used.where("in_text").select(F.explode("terms").alias("term"), qid, tagged("text")),
        "globe_terms": globe.withColumn("morton", geo.encode(F.col("lat"), F.col("lon"))),
        "temporal_terms": times.where(F.col("date_code") != dates.MALFORMED),
        "astro_terms": astro.withColumn("morton", geo.encode(F.col("lat"), F.col("lon"), geo.CELESTIAL)),
        "sitelinks": own.select(F.explode("own_links").alias("l"), "id").select("l.lang", "l.title", F.col("id").alias("qid")),
        "metadata": metadata(own, s),
        "property_rows": property_rows(described),
    }


def metadata(used: DataFrame, s: Settings) -> DataFrame:
    """qid, claims (map of exported values by property) and body, the rendered line; entities without exported claims have an empty one."""
    values = F.transform_values("claims", lambda pid, c: claim_values(c, s.languages, s.exported_datatypes))
    claims = F.map_filter(F.coalesce(values, F.create_map().cast("map<string,array<string>>")), lambda pid, v: F.size(v) > 0)
    return used.select(T.parse_id(F.col("id")).alias("qid"), claims.alias("claims")).withColumn("body", T.render_claims(F.col("claims")))


def property_rows(described: DataFrame) -> DataFrame:
    """pid, lang, label, description and datatype of admitted properties; a missing description is empty."""
    rows = described.where("used_property").select("id", "datatype", "descriptions", F.explode("own_labels").alias("l"))
    described_as = F.coalesce(F.col("descriptions")[F.col("l.key")]["value"], F.lit(""))
    return rows.select(T.parse_id(F.col("id")).alias("pid"), F.col("l.key").alias("lang"), F.col("l.value.value").alias("label"), described_as.alias("description"), "datatype")


def property_usage(described: DataFrame, s: Settings, n: int = 25) -> DataFrame:
    """The n properties with most exported values."""
    from .tags import usage

    rows = described.where(F.col("kind") == "item").select(F.explode("claims").alias("pid", "c"))
    values = rows.select("pid", F.explode(claim_values(F.col("c"), s.languages, s.exported_datatypes)).alias("v"))
    return usage(values, "pid", n)


def tag_usage(described: DataFrame, closure: DataFrame, index: str, tags: tuple[str, ...], n: int = 10) -> DataFrame:
    """The n tags that classes of the entities of an index reach most often, counted once for each class and tag."""
    from .tags import usage

    rows = described.where(F.col(f"in_{index}")).select(F.explode("classes").alias("child"))
    return usage(rows.join(closure.where(F.col("tag").isin(*tags)), "child"), "tag", n)


def lang_breakdown(described: DataFrame) -> DataFrame:
    """index, lang and n: entities of each index with an article in each language."""
    flags = F.filter(F.array(*[F.when(F.col(f"in_{i}"), F.lit(i)) for i in INDEXES]), lambda x: x.isNotNull())
    rows = described.select(F.explode(flags).alias("index"), F.array_distinct(F.transform("own_links", lambda x: x["lang"])).alias("langs"))
    return rows.select("index", F.explode("langs").alias("lang")).groupBy("index", "lang").agg(F.count(F.lit(1)).alias("n"))


def metrics(described: DataFrame) -> DataFrame:
    """One row: lines read, used and skipped, and for each index its entities with and without an article."""
    count = lambda c: F.count_if(c)
    item = F.col("kind") == "item"
    out = [F.count(F.lit(1)).alias("lines_read"), count(item).alias("items"), count(F.col("kind") == "property").alias("properties"), count("used").alias("items_used"), count("used_property").alias("properties_used")]
    out.append(count(~F.col("used") & ~F.col("used_property")).alias("lines_skipped"))
    for i in INDEXES:
        own = F.col(f"in_{i}")
        out += [count(own).alias(f"{i}_used"), count(own & F.col("has_article")).alias(f"{i}_with_article"), count(own & ~F.col("has_article")).alias(f"{i}_without_article")]
    return described.agg(*out)


def sanity_checks(counted: DataFrame, written: DataFrame) -> DataFrame:
    """The six identities over metrics() and the metadata rows written."""
    n = written.agg(F.count(F.lit(1)).alias("metadata_rows"))
    checks = [(F.col("metadata_rows") == F.col("items_used")).alias("metadata_adds_up")]
    checks += [(F.col(f"{i}_with_article") + F.col(f"{i}_without_article") == F.col(f"{i}_used")).alias(f"{i}_adds_up") for i in INDEXES]
    checks.append((F.col("items_used") + F.col("properties_used") + F.col("lines_skipped") == F.col("lines_read")).alias("lines_add_up"))
    return counted.crossJoin(n).select(*checks)  # one row by one row


def entity_edges(described: DataFrame, s: Settings, subclass_property: str = "P279") -> DataFrame:
    """child and parent of the class hierarchy that the dump states itself."""
    rows = described.select("id", F.explode(direct_classes(F.col("claims")[subclass_property])).alias("parent"))
    return rows.select(F.col("id").alias("child"), "parent").distinct()


def union_vocabularies(*tags: DataFrame) -> DataFrame:
    """The distinct tags of several one-column tables."""
    return reduce(DataFrame.union, [t.toDF("tag") for t in tags]).distinct()
