"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column for comparison; ``special`` overrides per column."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    # adding zero turns a negative zero into zero
    return df.withColumns({c: F.round(F.col(c), special.get(c, digits)) + F.lit(0.0) for c in doubles})
