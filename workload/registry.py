"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over a table folder, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = _with_places(sql)
        return fn

    return add


def _with_places(sql: str) -> str:
    from workload.tables import PLACES_SQL

    body = sql.strip()
    if not re.search(r"\bplaces\b", body):
        return body
    rest = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.IGNORECASE)
    if rest != body:
        recursive = "RECURSIVE " if re.match(r"with\s+recursive\s", body, flags=re.IGNORECASE) else ""
        return f"WITH {recursive}places AS ({PLACES_SQL}), {rest}"
    return f"WITH places AS ({PLACES_SQL}) {body}"
