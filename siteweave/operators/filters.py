"""Row filters, ledgers and set operations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bbox_filter(df: DataFrame, boxes: list[tuple[float, float, float, float]], mode: str = "include", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows in (or outside) any box (lat0, lon0, lat1, lon1), bounds included; another mode keeps all rows."""
    if mode not in ("include", "exclude") or not boxes:
        return df
    inside = reduce(lambda a, b: a | b, [F.col(lat).between(a, c) & F.col(lon).between(b, d) for a, b, c, d in boxes])
    return df.where(inside if mode == "include" else ~inside)


def coordinates_valid(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.col(lat).isNotNull() & ~F.isnan(lat) & F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(lon) & F.col(lon).between(-180, 180)


def valid_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(coordinates_valid(lat, lon))


def split_blocks(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by block: satellite, coords, environment."""
    sat = [c for c in columns if c.startswith(("patch_", "pca_", "umap_"))]
    xy = [c for c in columns if c in ("latitude", "longitude")]
    return {"satellite": sat, "coords": xy, "environment": [c for c in columns if c not in {*sat, *xy}]}


def with_ledger(df: DataFrame, key: str, stage: str, reasons: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): skipped has (id, reason, stage), the reason being the first condition that holds."""
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in reasons])
    marked = df.withColumn("__reason", reason)
    kept = marked.where("__reason is null").drop("__reason")
    return kept, marked.where("__reason is not null").select(F.col(key).alias("id"), F.col("__reason").alias("reason"), F.lit(stage).alias("stage"))


def same_shape(df: DataFrame, array: str) -> DataFrame:
    """Rows whose array has the commonest size (the smaller one of equally common ones)."""
    sizes = df.where(F.col(array).isNotNull()).groupBy(F.size(array).alias("__n")).agg(F.count(F.lit(1)).alias("__c")).orderBy(F.desc("__c"), "__n").limit(1)
    return df.join(F.broadcast(sizes), F.size(array) == F.col("__n")).select(*df.columns)  # one row


def scene_filter(scenes: DataFrame, max_cloud: float, first: str, last: str, orbit: str = "both") -> DataFrame:
    """Scenes under the cloud limit from the day first to the day last and one second."""
    kept = scenes.where((F.col("cloud") < max_cloud) & (F.col("dt") >= F.to_timestamp(F.lit(first))) & (F.col("dt") <= F.to_timestamp(F.lit(last)) + F.expr("interval 1 second")))
    return kept if orbit == "both" else kept.where(F.col("orbit") == orbit)


def label_variables(df: DataFrame, labels: dict[str, str], column: str) -> DataFrame:
    """The readable name of each variable; unknown names stay. labels is a short list, written as a map."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn("label", F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_keys(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in every group of the table."""
    n = df.agg(F.count_distinct(group).alias("__all"))
    return df.groupBy(key).agg(F.count_distinct(group).alias("__n")).join(F.broadcast(n), F.col("__n") == F.col("__all")).select(key)  # one row


def common_rows(df: DataFrame, key: str, group: str) -> DataFrame:
    return df.join(common_keys(df, key, group), key, "left_semi")


def complement(df: DataFrame, fold: int, column: str = "fold") -> DataFrame:
    return df.where(F.col(column) != fold)


def pending(inputs: DataFrame, done: DataFrame, key: str, valid: Column) -> DataFrame:
    """Inputs without a valid output yet."""
    return inputs.join(done.where(valid).select(key), key, "left_anti")


def resume(inputs: DataFrame, path: str, key: str, valid: Column, produce: Callable[[DataFrame], DataFrame], partition: str | None = None) -> DataFrame:
    """Makes what is missing of a table at path and returns the whole table.

    Inputs that have a valid output there are skipped; produce() makes the rows of the others, which
    replace the partitions that they fall in and leave the rest (dynamic partition overwrite), so a
    run that was lost is taken up, and one that is repeated changes nothing. partition is the key, if
    not given: then no partition is shared by a done and a pending input.
    """
    spark = inputs.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    todo = inputs if done is None else pending(inputs, done, key, valid)
    produce(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition or key).parquet(path)
    return spark.read.parquet(path)


def guard(df: DataFrame, keys: list[str], least: int, distinct: str | None = None, least_distinct: int = 2) -> DataFrame:
    """Keys with rows (and distinct values) enough, with their counts."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.count_distinct(distinct).alias("n_distinct")] if distinct else [])
    out = df.groupBy(*keys).agg(*aggs).where(F.col("n") >= least)
    return out.where(F.col("n_distinct") >= least_distinct) if distinct else out
