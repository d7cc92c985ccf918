"""Mosaics as scenes arrive equal one batch, after any split, replay and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from siteweave.operators import raster
from siteweave.streaming import scenes

COLUMNS = {"day": "day", "r": "r", "c": "c", "priority": "p", "valid": "ok", "b1": "b1", "b2": "b2"}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    return [(f"2024-01-0{rng.randint(1, 3)}", rng.randint(0, 4), rng.randint(0, 4), i, rng.random() < 0.4, rng.random(), None if rng.random() < 0.1 else rng.random()) for i in range(400)]


def whole(spark, rows):
    df = spark.createDataFrame(rows, "day string, r int, c int, p long, ok boolean, b1 double, b2 double").withColumn("day", F.to_date("day"))
    picture = raster.mosaic_first_valid(df, ["day", "r", "c"], ["b1", "b2"], "p", F.col("ok"))
    pixels = df.groupBy("day", "r", "c").agg(F.max("ok").alias("ok"))
    return sorted(map(tuple, picture.collect())), sorted(map(tuple, raster.coverage(pixels, ["day"], F.col("ok"), 60.0).collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_batches_equal_one_table(spark, rows, tmp_path, parts):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    mixed = rows[:]
    random.Random(parts).shuffle(mixed)
    for k in range(parts):
        # A part comes with some rows of the one before, as a repeated scene does.
        own = mixed[max(0, k * len(mixed) // parts - 30) : (k + 1) * len(mixed) // parts]
        df = spark.createDataFrame(own, "day string, r int, c int, p long, ok boolean, b1 double, b2 double").withColumn("day", F.to_date("day"))
        df.repartition(2).write.mode("append").parquet(source)
        picture, cover = scenes.incremental_mosaic(spark, source, COLUMNS, folder, ["r", "c"], ["b1", "b2"], least=60.0)
        seen = mixed[: (k + 1) * len(mixed) // parts]
        want = whole(spark, seen)
        assert (sorted(map(tuple, picture.collect())), sorted(map(tuple, cover.collect()))) == want
        if k == 1:
            scenes.compact_mosaic(spark, folder, ["r", "c"], ["b1", "b2"])
            again, _ = scenes.incremental_mosaic(spark, source, COLUMNS, folder, ["r", "c"], ["b1", "b2"], least=60.0)
            assert sorted(map(tuple, again.collect())) == want[0]
