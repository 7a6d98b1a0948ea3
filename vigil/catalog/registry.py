"""Registry of queries: a Spark function and, where SQL can say it, an oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.catalog.feeds import VIEWS, feed, oracle_view, stream_feed, table as read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(view)``; ``view(name)`` gives a feed, a feed as a stream or a driver table.

    In the oracle text ``@name`` stands for a feed.
    """
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def view(source: str) -> DataFrame:
                if source.startswith("stream:"):
                    return stream_feed(spark, sf_dir, source[7:])
                if source.startswith("table:"):
                    return read_table(spark, sf_dir, source[6:])
                return feed(spark, sf_dir, source)
            return function(view)
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _expand(sql)
        return function
    return add


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows(table) -> str:
    """Constant rows as the inside of VALUES."""
    def one(v):
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(one(x) for x in v) + "]"
        if isinstance(v, str):
            return quote(v)
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return "NULL" if v is None else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in table)


def _expand(sql: str) -> str:
    used = sorted(set(re.findall(r"(?<=\s)@(\w+)", sql)))
    for name in used:
        if name not in VIEWS:
            raise KeyError(name)
    body = re.sub(r"(?<=\s)@(\w+)", r"v_\1", sql.strip())
    views = ", ".join(f"v_{n} AS ({oracle_view(n)})" for n in used)
    if not views:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {views}, " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\s", body):
        return f"WITH {views}, " + body[4:].lstrip()
    return f"WITH {views} {body}"
