"""Named queries over the tables of a directory, each with an equivalent SQL text where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function under its name; ``views`` are the common table expressions that its SQL needs."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return function

    return register
