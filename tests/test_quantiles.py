"""Quantiles by key: exact ones by every way, and the rank error of sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import aggregates, quantiles

QS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=4000).round(2), np.zeros(2500)])
    return [(None if i % 3 == 0 else "a" if i % 3 == 1 else "b", float(x)) for i, x in enumerate(v)] + [("a", None), ("a", float("nan")), ("c", None), ("d", 4.0), ("e", -1.0), ("e", 3.0)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("size", [quantiles.SKETCH_SIZE, 8])
def test_selected_quantiles_are_exact(df, rows, size):
    # A sketch of size 8 misses ranks, which are then found among all values of the key.
    got = {r["g"]: r["q"] for r in quantiles.selected(df, ["g"], "v", QS, size).collect()}
    assert set(got) == {None, "a", "b", "d", "e"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in rows if k == g and v is not None and v == v], QS))


def test_both_ways_agree_and_join_to_groups(df):
    grouped = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    a, b = ({r["g"]: r for r in quantiles.with_quantiles(grouped, df, ["g"], F.col("v") * 2, {"m": 0.5, "h": 0.9}, rows).collect()} for rows in (quantiles.GROUP_ROWS, 10))
    assert a == b and len(a) == 6 and a["c"]["m"] is None and a["e"]["m"] == 2.0
    assert quantiles.keyed_quantiles(df.limit(0), ["g"], "v", [0.5], -1).count() == 0
    one = [quantiles.keyed_quantiles(df, [], "v", [0.5], n).collect() for n in (quantiles.GROUP_ROWS, 10)]
    assert one[0] == one[1] and len(one[0]) == 1


def test_sketches_merge_and_keep_their_rank_error(spark):
    n = 1_000_000
    wide = spark.range(n, numPartitions=8).select((F.col("id") % 5).alias("g"), (F.col("id") % 7).alias("day"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    parts = quantiles.sketches(wide, ["g", "day"], "v")
    assert parts.count() == 35
    got = {r["g"]: r for r in quantiles.from_sketches(quantiles.merged_sketches(parts, ["g"]), ["g"], QS[1:-1]).collect()}
    for g in range(5):
        below = wide.where(F.col("g") == g).agg(F.count(F.lit(1)), *[F.count_if(F.col("v") <= x) for x in got[g]["q"]]).first()
        assert got[g]["n"] == below[0] == n // 5
        assert all(abs(b / below[0] - q) <= quantiles.rank_error() for b, q in zip(below[1:], QS[1:-1], strict=True))


def test_reports_have_their_functions(spark):
    runs = spark.createDataFrame([("A", "A", 0.8), ("A", "A", 0.6), ("B", "A", 0.4), ("A", "B", 0.1), ("C", "C", None)], "s string, t string, r2 double")
    got = {(r["source"], r["target"]): r["drop"] for r in aggregates.transfer_drop(runs, "s", "t").collect()}
    assert got[("A", "A")] == 0 and abs(got[("B", "A")] + 0.3) < 1e-9 and got[("A", "B")] is None
    v = aggregates.cv_verdict(runs.where("s = 'A'"), "t", "A").first()
    assert abs(v["worst"] - 0.1) < 1e-9 and abs(v["max_drop"] - 0.6) < 1e-9 and v["holds"] is False
    e = aggregates.error_summary(spark.createDataFrame([(1.0, 2.0), (0.0, 3.0), (4.0, 4.0)], "y double, yhat double"), []).first()
    assert e["n"] == 3 and e["median"] == 1.0 and e["mean_percent"] == 50.0
    years = spark.createDataFrame([(1, 1, 2017, 1.0), (2, 1, 2017, 2.0), (1, 1, 2024, 3.0), (2, 1, 2024, 5.0), (3, 1, 2024, 5.0)], "k long, seed long, year long, yhat double")
    s = aggregates.prediction_stability(years, "k", "year", "seed", 2017, 2024).first()
    assert (s["n"], s["r"], s["mad"]) == (2, 1.0, 2.5)
    assert sorted(r["diff"] for r in aggregates.change_map(years, ["k", "seed"], "year", "yhat", 2017, 2024).collect()) == [2.0, 3.0]
