"""Registry of queries and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.fixtures import TABLES, VIEWS, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in needed]
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    if body[:4].upper() == "WITH":
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {recursive}{', '.join(views)}, {rest}"
    return f"WITH {', '.join(views)} {body}"


def query(name: str, sql: str | None = None):
    """Register ``build(fx)`` under ``name``; ``sql`` is the DuckDB twin."""

    def register(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Fixtures(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return build

    return register


__all__ = ["QUERIES", "ORACLE", "TABLES", "Fixtures", "query", "with_views"]
