"""Patience of boosting, and quantile regression against its definition."""

import numpy as np
from pyspark.sql import functions as F

from siteweave.operators import aggregates, learn


def frame(spark, n=900, noise=1.0):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 4))
    y = 5 + 3 * x[:, 0] - 2 * x[:, 1] + noise * (0.5 + np.abs(x[:, 2])) * rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k long, a double, b double, c double, d double, y double")
    return learn.vectors(df, F.array("a", "b", "c", "d")).repartition(3), x, y


def test_the_rule_of_patience():
    assert learn.best_round([5, 4, 3, 3, 3, 2], 3) == (6, False)
    assert learn.best_round([5, 4, 3, 3, 3, 3, 2], 3) == (3, True)
    assert learn.best_round([1.0], 3) == (1, False) and learn.best_round([3, 2, 1], 1) == (3, False)


def test_boosting_keeps_the_best_round(spark):
    df, _, _ = frame(spark, 300, 3.0)
    rows = df.select("k", "y", F.col("features").alias("reduced"), (F.col("k") % 4 == 0).alias("validation")).cache()
    model = learn.PatientBoosting(3, rounds=60, step=0.4, depth=3, patience=4, first=8).fit(rows)
    # By hand: all rounds at once, the error of each by the sum of the trees so far.
    whole = learn.PatientBoosting(3, rounds=60, step=0.4, depth=3).of(60).fit(rows.where("not validation"))
    shown = rows.where("validation").collect()
    each = np.array([[w * t.predict(r["reduced"]) for t, w in zip(whole.trees, whole.treeWeights)] for r in shown])
    errors = ((np.cumsum(each, axis=1) - np.array([r["y"] for r in shown])[:, None]) ** 2).mean(0)
    best = next((i for i in range(60) if i >= 4 and errors[: i + 1].argmin() <= i - 4), 59)
    assert len(model.trees) == errors[: best + 1].argmin() + 1 < 60
    assert np.allclose([model.predict(r["reduced"]) for r in shown[:20]], np.cumsum(each, axis=1)[:20, len(model.trees) - 1])
    assert len(learn.PatientBoosting(3, rounds=5).fit(rows.withColumn("validation", F.lit(False))).trees) == 5


def test_quantile_regression_minimises_the_pinball_loss(spark):
    df, x, y = frame(spark)
    rows = df.select("k", "y", F.col("features").alias("reduced"))
    qs = (0.05, 0.5, 0.95)
    beta = learn.QuantileRegression(qs).fit(rows)
    design = np.column_stack([np.ones(len(x)), x])
    loss = lambda b, q: np.mean(np.maximum(q * (y - design @ b), (q - 1) * (y - design @ b)))
    rng = np.random.default_rng(1)
    for b, q in zip(beta, qs):
        at = loss(b, q)
        # Nothing near is lower by more than the smoothing costs.
        assert all(loss(b + rng.normal(size=5) * s, q) > at * 0.99 for s in (0.02, 0.1, 0.5) for _ in range(40))
        assert abs(np.mean(y <= design @ b) - q) < 0.03


def test_intervals_cover_held_out_rows_no_worse_than_conformal_ones(spark):
    df, _, _ = frame(spark, 3000)
    train, test = df.where("k % 3 <> 0"), df.where("k % 3 = 0")
    got = learn.fit_quantiles(train, test, reducer="none")
    m = aggregates.interval_metrics(got, []).first()
    assert abs(m["coverage"] - 0.90) <= 0.03 and got.where("lo > hi").count() == 0
    model = learn.fit_pipeline(train.where("k % 2 = 0"), "ridge", "none")
    conformal = learn.conformal(learn.predict(model, train.where("k % 2 = 1")), learn.predict(model, test))
    c = aggregates.interval_metrics(conformal, []).first()
    assert m["pinball_05"] <= 1.05 * c["pinball_05"] and m["pinball_95"] <= 1.05 * c["pinball_95"]
