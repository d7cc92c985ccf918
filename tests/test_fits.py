"""Fits of a scheme's folds."""

import threading
import time

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siteweave.operators import learn


def test_folds_are_fitted_side_by_side_with_the_results_of_single_fits(spark):
    x = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))
    df = spark.range(150).select(F.col("id").alias("k"), array_to_vector(x).alias("features"), (F.col("id") % 7 * 2.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold")).cache()
    all_there = threading.Barrier(3, timeout=90)

    class Meeting:
        def __init__(self, seed):
            self.forest = learn.forest(seed, trees=3, depth=3)

        def fit(self, rows):
            all_there.wait()
            return self.forest.fit(rows)

    got = {r["k"]: (r["fold"], r["yhat"]) for r in learn.cross_predict(df, Meeting, "none").collect()}
    assert len(got) == 150
    for fold in range(3):
        model = learn.fit_pipeline(df.where(F.col("fold") != fold), lambda seed: learn.forest(seed, trees=3, depth=3), "none")
        for r in learn.predict(model, df.where(F.col("fold") == fold)).collect():
            assert got[r["k"]] == (fold, r["yhat"])


def test_components_of_folds_that_are_fitted_side_by_side_are_found_one_at_a_time(spark, monkeypatch):
    x = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"), (F.col("id") % 11).cast("double"))
    df = spark.range(150).select(F.col("id").alias("k"), array_to_vector(x).alias("features"), (F.col("id") % 7 * 2.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold")).cache()
    real, guard, inside, most = learn.PCA, threading.Lock(), [0], [0]

    class Watched:
        def __init__(self, **given):
            self.pca = real(**given)

        def fit(self, rows):
            with guard:
                inside[0] += 1
                most[0] = max(most[0], inside[0])
            try:
                time.sleep(2)
                return self.pca.fit(rows)
            finally:
                with guard:
                    inside[0] -= 1

    monkeypatch.setattr(learn, "PCA", Watched)
    got = learn.cross_predict(df, lambda seed: learn.forest(seed, trees=3, depth=3), "pca")
    assert got.count() == 150 and most == [1]
