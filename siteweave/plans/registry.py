"""The queries by name, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers a function of the named views' DataFrames as a query, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; NaN as null, -0.0 as 0.0."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        out.append((F.nullif(F.round(c, digits) + 0.0, F.lit(float("nan")))).alias(n) if t == "double" else c)
    return df.select(*out)
