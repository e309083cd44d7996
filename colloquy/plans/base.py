"""Registering queries beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.functions.numeric import NUDGE
from colloquy.sources.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use ``views`` by name. A name can be taken once."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            for digits in (4, 6):  # as functions.numeric.rounded
                body = body.replace(f", {digits}) + 0.0", f" + {NUDGE}, {digits}) + 0.0")
            heads = ",\n".join(f"{v} AS (\n{VIEWS[v]})" for v in views)
            word = "WITH RECURSIVE" if body.startswith("WITH RECURSIVE ") else "WITH"
            if heads and body.startswith("WITH "):
                body = f"{word} {heads},\n{body[len(word) + 1 :]}"
            elif heads:
                body = f"WITH {heads}\n{body}"
            ORACLES[name] = body
        return f

    return register
