"""Scans of runs, summaries and logs, resumed tables, pruned bands, ranks with ties and small raster functions."""

import numpy as np
from pyspark.sql import functions as F

from siteweave.operators import aggregates, filters, ranking, raster
from siteweave.sources import files, samples


def test_runs_summaries_logs_and_manifests(spark, tmp_path):
    for name, r2 in (("rf_soil_a_20240101-120000", 0.5), ("lightgbm", 0.6), ("notes", 0.7)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metrics.csv").write_text(f"run_seed,r2\n1,{r2}\n")
    found = files.scan_runs(spark, str(tmp_path / "runs"), "metrics.csv", "run_seed long, r2 double", bare="rf|lightgbm")
    assert sorted((r["model"], r["config"], r["r2"]) for r in found.collect()) == [("lightgbm", None, 0.6), ("rf", "soil_a", 0.5)]
    assert files.scan_runs(spark, str(tmp_path / "runs"), "metrics.csv", "run_seed long, r2 double").count() == 1
    (tmp_path / "sums" / "deep").mkdir(parents=True)
    (tmp_path / "sums" / "a.json").write_text('{"config": "a",\n "r2_mean": 0.1}')
    (tmp_path / "sums" / "deep" / "b.json").write_text('{"config": "b", "r2_mean": 0.4, "rmse_mean": 2.0}')
    got = [tuple(r) for r in files.scan_summaries(spark, str(tmp_path / "sums"), "config string, r2_mean double, rmse_mean double").collect()]
    assert got == [("b", 0.4, 2.0), ("a", 0.1, None)]
    (tmp_path / "logs").mkdir()
    for name, text in (("t1.log", "x\nPartition complete: succeeded\n"), ("t2.log", "stopped\n"), ("t.3.log", "")):
        (tmp_path / "logs" / name).write_text(text)
    assert sorted(tuple(r) for r in files.failed_ids(spark, str(tmp_path / "logs")).collect())[-1] == ("t2", "failure")
    spark.createDataFrame([(2022, 5), (2023, 6)], "year int, lon_i long").write.partitionBy("year").parquet(str(tmp_path / "registry"))
    year = samples.scan_registry(spark, str(tmp_path / "registry"), 2023)
    assert year.count() == 1 and "PartitionFilters: [isnotnull(year" in year._jdf.queryExecution().toString()


def test_a_lost_run_is_taken_up(spark, tmp_path):
    path, made = str(tmp_path / "out"), []

    def produce(todo):
        made.append(sorted(r["k"] for r in todo.collect()))
        return todo.withColumn("v", F.col("k") * 2)

    keys = spark.range(6).withColumnRenamed("id", "k")
    assert filters.resume(keys.where("k < 2"), path, "k", F.col("v") > 0, produce).count() == 2
    got = filters.resume(keys, path, "k", F.col("v") > 0, produce)
    # 0 has no valid output and is made again; 1 stays.
    assert made == [[0, 1], [0, 2, 3, 4, 5]] and {r["k"]: r["v"] for r in got.collect()} == {k: 2 * k for k in range(6)}
    again = filters.resume(keys.where("k > 0"), path, "k", F.col("v") > 0, produce)
    assert made[-1] == [] and again.count() == 6


def test_only_partitions_of_covered_dates_are_read(spark, tmp_path):
    rows = [(d, i, float(i)) for d in range(8) for i in range(20)]
    spark.createDataFrame(rows, "d int, i int, b double").write.partitionBy("d").parquet(str(tmp_path / "bands"))
    quality = spark.createDataFrame([(d, i % 10 < d) for d in range(8) for i in range(20)], "d int, ok boolean")
    got = raster.covered_bands(spark.read.parquet(str(tmp_path / "bands")), quality, "d", F.col("ok"), 60.0)
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    assert {r["d"] for r in got.collect()} == {6, 7} and got.count() == 40


def test_an_item_stays_if_a_band_passes(spark):
    rows = [("a", 1.0, 0.0), ("a", 2.0, 1.0), ("b", 0.0, None), ("b", float("nan"), -1.0), ("c", 1.0, 1.0), ("d", None, 5.0)]
    got = {r["item"]: r for r in raster.band_coverage(spark.createDataFrame(rows, "item string, vv double, vh double"), ["item"], ["vv", "vh"], 60.0).collect()}
    assert set(got) == {"a", "c", "d"} and (got["a"]["vv_kept"], got["a"]["vh_kept"], got["a"]["vh_percent"]) == (True, False, 50.0)
    assert (got["d"]["vv_kept"], got["d"]["vh_kept"]) == (False, True)


def test_channels_and_categories_without_a_value(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0, 4.0, float("nan"), 8.0]), (2, [None, 1.0, None, 1.0, None, 1.0])], "k int, patch array<double>")
    got = {r["k"]: r["patch"] for r in raster.impute_channels(df, "patch", 2).collect()}
    assert got == {1: [1.0, 6.0, 3.0, 4.0, 2.0, 8.0], 2: [0.0, 1.0, 0.0, 1.0, 0.0, 1.0]}
    c = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "k int, c int")
    assert [tuple(r)[2:] for r in aggregates.one_hot(c, "c", "x_", [10], "class").orderBy("k").collect()] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert aggregates.one_hot(c, "c", "x_", [10], "drop").count() == 2


def test_ranks_of_few_values_are_spread(spark):
    rng = np.random.default_rng(1)
    v = [None if x > 0.95 else int(x * 4) for x in rng.random(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v int").repartition(5)
    for descending in (False, True):
        got = ranking.global_rank(df, "v", descending).collect()
        order = sorted(range(len(v)), key=lambda i: (v[i] is None, -(v[i] or 0) if descending else v[i] or 0))
        assert sorted(r["row"] for r in got) == list(range(1, len(v) + 1))
        assert [v[r["i"]] for r in sorted(got, key=lambda r: r["row"])] == [v[i] for i in order]
        first, n = {}, {}
        for p, i in enumerate(order):
            first.setdefault(v[i], p)
            n[v[i]] = n.get(v[i], 0) + 1
        assert all(r["rank"] == first[v[r["i"]]] + (n[v[r["i"]]] + 1) / 2 for r in got)
