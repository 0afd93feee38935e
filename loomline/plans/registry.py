"""Queries over the driver's tables, each registered with the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that several queries share

_NAMES = "['winter', 'spring', 'summer', 'fall']"


def moved(day: str) -> str:
    """A start, moved into the next quarter if it leads into it."""
    late = " OR ".join(f"(month({day}) = {m} AND day({day}) >= {d})" for m, d in ((3, 18), (6, 17), (9, 17), (12, 18)))
    return f"(CASE WHEN {late} THEN {day} + INTERVAL 1 MONTH ELSE {day} END)"


def year_of(day: str) -> str:
    return f"CAST(year({moved(day)}) AS INTEGER)"


def quarter_of(day: str) -> str:
    return f"{_NAMES}[quarter({moved(day)})]"


def order_of(day: str) -> str:
    return f"CAST(year({moved(day)}) * 12 + (quarter({moved(day)}) - 1) * 3 + 1 AS INTEGER)"


def calendar_order(day: str) -> str:
    return f"CAST(year({day}) * 12 + (quarter({day}) - 1) * 3 + 1 AS INTEGER)"
