"""Scenes that arrive as files: sums by day, and mosaics with their coverage, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_scenes(spark: SparkSession, source: str, columns: dict[str, str], folder: str, files: str = "*.parquet", late: str = "30 days") -> DataFrame:
    """(day, orbit, n, clearest): scenes of each day and orbit with the least cloud, from the files in source that match `files`.

    columns maps item_id, dt, cloud and orbit to SQL expressions over the source. Each call takes
    the files that came since the last one (the checkpoint under folder remembers them) and returns
    the totals of all calls. A scene that comes twice within `late` counts once; one that is later
    than that is dropped, as its state is gone. Each batch writes its partial sums to a folder of
    its own, which a repeated batch replaces, so a lost executor or driver counts nothing twice.
    """
    schema = spark.read.option("pathGlobFilter", files).parquet(source).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    once = rows.withWatermark("dt", late).dropDuplicatesWithinWatermark(["item_id"])
    sums, marks = f"{folder}/sums", f"{folder}/checkpoint"

    def add(batch: DataFrame, number: int) -> None:
        day = F.to_date("dt").alias("day")
        part = batch.groupBy(day, F.coalesce("orbit", F.lit("unknown")).alias("orbit")).agg(F.count(F.lit(1)).alias("n"), F.min("cloud").alias("clearest"))
        part.write.mode("overwrite").parquet(f"{sums}/batch={number}")

    once.writeStream.foreachBatch(add).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sums).groupBy("day", "orbit").agg(F.sum("n").alias("n"), F.min("clearest").alias("clearest"))


def _best(rows: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """The valid source of least priority of each pixel and day, and its bands; without one, null. Merging again what is merged changes nothing."""
    valid = F.col("priority").isNotNull()
    return rows.groupBy("day", *keys).agg(F.min("priority").alias("priority"), F.min_by(F.struct(*bands), F.when(valid, F.col("priority"))).alias("b")).select("day", *keys, "priority", "b.*")


def _state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All that has come: the last compacted table, and the batches since."""
    upto = spark.read.schema("upto long").parquet(f"{folder}/compacted").agg(F.max("upto")).first()[0]
    batches = spark.read.schema(schema).parquet(f"{folder}/batches")
    if upto is None:
        return batches.drop("batch")
    whole = spark.read.schema(schema).parquet(f"{folder}/state/upto={upto}").select(*[c for c in batches.columns if c != "batch"])
    return batches.where(F.col("batch") > upto).drop("batch").unionByName(whole)


def incremental_mosaic(spark: SparkSession, source: str, columns: dict[str, str], folder: str, keys: list[str], bands: list[str], files: str = "*.parquet", least: float = 0.0, fill: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(mosaic, coverage) of all files that have come to source so far.

    columns maps day, the keys of a pixel, priority (a number), valid and the bands to SQL
    expressions over the source. mosaic (day, keys, bands) has each pixel's bands from its valid
    source of least priority, or fill; coverage (day, percent, n) the percent of the day's pixels
    that have one, where it reaches least. Each call takes the files that came since the last one.

    A batch writes the best source of its own pixels, by day, to a folder of its own, which a repeated batch
    replaces; the best of bests is the best of all, so neither the split into batches nor a source
    that comes twice changes the result. compact_mosaic() merges the batches; priorities of a pixel's sources differ.
    """
    schema = spark.read.option("pathGlobFilter", files).parquet(source).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    rows = rows.withColumn("priority", F.when(F.col("valid"), F.col("priority"))).drop("valid")
    kept = rows.select(F.lit(0).cast("long").alias("batch"), "day", *keys, "priority", *bands).schema
    spark.createDataFrame([], "upto long").write.mode("append").parquet(f"{folder}/compacted")

    def add(batch: DataFrame, number: int) -> None:
        _best(batch, keys, bands).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batches/batch={number}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    best = _best(_state(spark, folder, kept), keys, bands)
    cover = best.groupBy("day").agg((100 * F.avg(F.col("priority").isNotNull().cast("double"))).alias("percent"), F.count(F.lit(1)).alias("n")).where(F.col("percent") >= least)
    return best.select("day", *keys, *[F.coalesce(F.col(b).cast("double"), F.lit(fill)).alias(b) for b in bands]), cover


def compact_mosaic(spark: SparkSession, folder: str, keys: list[str], bands: list[str]) -> None:
    """Merges the batches of incremental_mosaic() into one table by day.

    It is written beside what there is and entered in the list of compacted tables only when it is
    whole, so a run that is lost leaves the batches in use.
    """
    batches = spark.read.parquet(f"{folder}/batches")
    last = batches.agg(F.max("batch")).first()[0]
    if last is None:
        return
    schema = batches.select(F.col("batch").cast("long").alias("batch"), "day", *keys, "priority", *bands).schema
    _best(_state(spark, folder, schema), keys, bands).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/state/upto={last}")
    spark.createDataFrame([(int(last),)], "upto long").write.mode("append").parquet(f"{folder}/compacted")
