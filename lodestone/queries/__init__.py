"""Queries over the driver tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from . import build, ingest, searches

QUERIES: dict = searches.QUERIES | build.QUERIES | ingest.QUERIES
SQL: dict[str, str] = searches.SQL | build.SQL | ingest.SQL
