"""Column expressions on strings: titles, links, claims, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a border line is made of. Fixed values.
BORDER = "-_=*+ ─│┌┬┐├┼┤└┴┘"
#: Headings that start sections to drop. Fixed values.
UNWANTED_SECTIONS = ("## Further reading", "## External links", "## References", "## Bibliography", "## Notes")
LONGEST_LINE, BORDER_WIDTH, MOST_SPACES = 100, 80, 10


def percent_decode(text: Column) -> Column:
    """Plain percent-decoding ('+' stays), the text itself where an escape is bad."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def title_key(title: Column, url: Column) -> Column:
    """First key of a page: its title, else its decoded URL; spaces for underscores, trimmed."""
    return F.trim(F.translate(F.when(F.coalesce(F.length(title), F.lit(0)) > 0, title).otherwise(percent_decode(url)), "_", " "))


def fallback_key(url: Column) -> Column:
    """Second key: the decoded URL with its first letter in upper case."""
    t = F.trim(F.translate(percent_decode(url), "_", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2_147_483_647))


def classify_link(href: Column) -> Column:
    external = href.startswith("http://") | href.startswith("https://") | href.startswith("//") | href.startswith("www.")
    return F.when(href.startswith("#"), "fragment").when(external, "external").otherwise("internal")


def term_bytes(term: Column, width: int = 56) -> Column:
    """UTF-8 of a term cut to `width` bytes, perhaps within a character."""
    return F.substring(F.encode(term, "utf-8"), 1, width)


def parse_id(text: Column) -> Column:
    """Number of an id such as Q42 or P31; 0 if it has none."""
    return F.coalesce(F.regexp_replace(text, "^[QP]", "").try_cast("long"), F.lit(0)).cast("long")


def quantity_number(text: Column) -> Column:
    """Number at the start of a rendered quantity, before bounds and unit; 0.0 if there is none."""
    return F.coalesce(F.trim(F.regexp_extract(text, r"^[^(\[]*", 0)).try_cast("double"), F.lit(0.0))


def render_quantity(amount: Column, lower: Column, upper: Column, unit: Column) -> Column:
    bounds = F.when(lower.isNotNull() & upper.isNotNull(), F.concat(F.lit("("), lower, F.lit(","), upper, F.lit(")"))).otherwise("")
    last = F.element_at(F.split(unit, "/"), -1)
    return F.concat(amount, bounds, F.when(unit.isNotNull() & (unit != "1"), F.concat(F.lit("["), last, F.lit("]"))).otherwise(""))


def render_claims(claims: Column) -> Column:
    """PID:v1;;v2 joined by TAB, properties in order, of a map from property to values."""
    entries = F.array_sort(F.map_entries(claims), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ";;"))), "\t")


def clean_line(line: Column) -> Column:
    """Long border lines to 80 characters; runs of more than ten spaces to three."""
    marks = "".join("\\" + c if c in "-_=*+" else c for c in BORDER)
    border = (F.length(line) > LONGEST_LINE) & F.regexp_like(line, F.lit(f"^[{marks}]*$"))
    return F.regexp_replace(F.when(border, F.substring(line, 1, BORDER_WIDTH)).otherwise(line), " {%d,}" % (MOST_SPACES + 1), "   ")


def envelope(qid: Column, body: Column) -> Column:
    return F.concat(F.lit("--- QID: "), qid, F.lit(" ---\n\n"), body, F.lit("\n\n"))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")
