"""Sample tables and tile registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("sample_id", "latitude", "longitude", "rarefied")
SCHEMA = "sample_id STRING, latitude DOUBLE, longitude DOUBLE, rarefied DOUBLE, continent STRING"


def unify_samples(tables: list[DataFrame], required: tuple[str, ...] = REQUIRED, optional: tuple[str, ...] = (), key: str = "sample_id") -> DataFrame:
    """One row for each id: the first by table, of rows without nulls in the required columns.

    Within a table the first is the one that sorts first, so that the choice doesn't hang on the
    order in which files are read. A table that lacks a required column is an error.
    """
    for t in tables:
        if missing := [c for c in required if c not in t.columns]:
            raise ValueError(f"columns are missing: {missing}")
    named = [t.select(*required, *[c for c in optional if c in t.columns]).withColumn("__at", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).dropna(subset=list(required)).withColumn(key, F.col(key).cast("string"))
    names = [*required, *[c for c in optional if c in rows.columns]]
    w = Window.partitionBy(key).orderBy("__at", *[c for c in names if c != key])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*names)


def load_samples(spark: SparkSession, paths: list[str], required: tuple[str, ...] = REQUIRED, optional: tuple[str, ...] = ("continent",)) -> DataFrame:
    """unify_samples() over CSV files with a header, in the order of paths."""
    tables = []
    for p in paths:
        names = spark.read.option("header", True).csv(p).columns
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        tables.append(spark.read.option("header", True).schema(", ".join(f"`{n}` {kinds.get(n, 'STRING')}" for n in names)).csv(p))
    return unify_samples(tables, required, optional)


def registry_year(registry: DataFrame, year: int) -> DataFrame:
    return registry.where(F.col("year") == year)


def scan_registry(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Rows of one year of a Parquet manifest; a year= folder is pruned."""
    return registry_year(spark.read.parquet(path), year)


def prune_registry(registry: DataFrame, points: DataFrame, year: int, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Registry rows of a year whose tile (integer hundredths of a degree) holds a point."""
    need = points.select((F.floor(F.col(lon) * 10) * 10 + 5).alias("lon_i"), (F.floor(F.col(lat) * 10) * 10 + 5).alias("lat_i")).distinct()
    return registry_year(registry, year).join(need, ["lon_i", "lat_i"], "left_semi").select(*registry.columns)


def coverage_report(samples: DataFrame, sources: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """(source, n, covered, share) for each source."""
    out = []
    for name, s in sources.items():
        hit = samples.select(key).join(s.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
        out.append(hit.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__hit", F.lit(0))).alias("covered"), F.avg(F.coalesce("__hit", F.lit(0))).alias("share")))
    return reduce(lambda a, b: a.union(b), out)
