"""Date codes: year * 10000 + month * 100 + day, for any year and with month or day 0 where they are unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first character is always the sign's place; '-' negates the year.
PATTERN = r"^(.)([0-9]+)-([0-9]+)-([0-9]+)"
MALFORMED = -1


def encode_date(text: Column) -> Column:
    """Code of a signed date string; -1 if it is null, empty or not of the form."""
    part = lambda i: F.regexp_extract(text, PATTERN, i)
    number = lambda i: F.expr("try_cast(null as bigint)") if i is None else part(i).try_cast("bigint")
    year = F.when(part(1) == "-", -number(2)).otherwise(number(2))
    return F.coalesce(F.when(part(2) != "", year * 10000 + number(3) * 100 + number(4)), F.lit(MALFORMED)).cast("long")


def decode_date(code: Column) -> tuple[Column, Column, Column]:
    """Year, month and day; floor division, so dates before year 0 decode to positive months."""
    rest = F.pmod(code, F.lit(10000))
    return ((code - rest) / 10000).cast("long"), (rest / 100).cast("int"), F.pmod(rest, F.lit(100)).cast("int")


def format_date(code: Column) -> Column:
    year, month, day = decode_date(code)
    return F.format_string("%d-%02d-%02d", year, month, day)
