"""Queries of neighbours, models, experiments and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import folds, joins, learn, neighbours
from ..session import checkpointed, shared_folder
from ..streaming.scenes import incremental_mosaic, incremental_scenes
from .fixtures import with_views
from .registry import ORACLES, QUERIES, query, rounded


def frame(s: DataFrame, p: DataFrame) -> DataFrame:
    """Samples with their vectors and a target that depends on two components, with noise from a hash.

    Fits read it many times, so it is joined, and its vectors made, once. Both sides are dealt by key: the tables are a few
    files, which one task would join and every pass would read again.
    """
    noise = (F.pmod(F.xxhash64("k"), F.lit(1000)) / 1000 - 0.5) * 8
    y = 100 + 60 * F.col("vec")[0].cast("double") - 40 * F.col("vec")[1].cast("double") + noise
    rows = s.join(p.hint("merge"), "sample_id").select("k", "sample_id", "latitude", "longitude", "continent", "biome_name", "vec", y.alias("y"))
    return checkpointed(learn.vectors(rows, "vec"))


def small_forest(seed: int):
    return learn.forest(seed, trees=20, depth=6)


def quick_boosted(seed: int):
    """Boosting with patience, in few and larger steps, as 1,000 rounds at 0.05 take minutes."""
    return learn.boosted(seed, rounds=30, step=0.2, patience=5)


KNN = "WITH d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d) SELECT vec_id, round(avg(d), 5) AS mean_distance, CAST(count(*) AS INT) AS n_neighbours FROM r WHERE r <= 10 GROUP BY vec_id"


@query("J11_knn_mean_distance", "embeddings", sql=KNN)
def _(e):
    return rounded(neighbours.knn_mean_distance(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), 10, "vec_id", "embedding"), 5)


SCALED = "WITH t AS (SELECT avg(CAST(vec[1] AS DOUBLE)) AS m, stddev_pop(CAST(vec[1] AS DOUBLE)) AS s, avg(CAST(vec[64] AS DOUBLE)) AS m2, stddev_pop(CAST(vec[64] AS DOUBLE)) AS s2 FROM f_patch WHERE CAST(sample_id AS BIGINT) % 5 <> 0) SELECT sample_id, round((vec[1] - m) / s, 5) + 0e0 AS z_0, round((vec[64] - m2) / s2, 5) + 0e0 AS z_63 FROM f_patch, t"


@query("M1_standardise", "f_patch", sql=SCALED)
def _(p):
    rows = learn.vectors(p, "vec")
    got = learn.apply(learn.fit_scaler(rows.where("CAST(sample_id AS BIGINT) % 5 <> 0")), rows)
    z = learn.vector_to_array("scaled")
    return rounded(got.select("sample_id", z[0].alias("z_0"), z[63].alias("z_63")), 5)


@query("M2_pca", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    z = learn.vector_to_array("reduced")
    return rounded(learn.apply(learn.fit_pca(df.where("k % 5 <> 0")), df).select("k", z[0].alias("pc_1"), z[1].alias("pc_2")), 4)


@query("M3_reducer_scope", "f_samples", "f_patch")
def _(s, p):
    df = folds.random_folds(frame(s, p), 3, 7)
    both = [learn.cross_predict(df, small_forest, "pca", None, 7, scope).withColumn("scope", F.lit(scope)) for scope in ("in_fold", "global")]
    return rounded(agg.regression_metrics(both[0].unionByName(both[1]), ["scope"]).select("scope", "r2", "rmse", "n"), 4)


@query("M4_whitened_distance", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    return rounded(learn.whitened_distance(df.where("k % 5 = 0"), df.where("k % 5 <> 0")).select("k", "whitened"), 4)


def held_out(df: DataFrame, make, reducer: str = "none") -> tuple[DataFrame, object]:
    fitted = learn.fit_pipeline(df.where("k % 5 <> 0"), make, reducer)
    return learn.predict(fitted, df.where("k % 5 = 0")), fitted


@query("M5_forest", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    fitted = held_out(df, learn.forest)[1]
    found = [(f"patch_{i}", float(v)) for i, v in enumerate(learn.importances(fitted))]
    return rounded(df.sparkSession.createDataFrame(found, "feature string, importance double"), 6)


@query("M6_boosted", "f_samples", "f_patch")
def _(s, p):
    return rounded(held_out(frame(s, p), quick_boosted)[0].select("k", "y", "yhat"), 4)


@query("M7_ridge", "f_samples", "f_patch")
def _(s, p):
    return rounded(held_out(frame(s, p), learn.MODELS["ridge"])[0].select("k", "y", "yhat"), 4)


CONFORMAL = "WITH c AS (SELECT * FROM f_preds WHERE fold <> 0), e AS (SELECT quantile_cont(yhat, 0.25) AS a, quantile_cont(yhat, 0.5) AS b, quantile_cont(yhat, 0.75) AS c FROM c), s AS (SELECT f.*, CASE WHEN yhat > e.c THEN 3 WHEN yhat > e.b THEN 2 WHEN yhat > e.a THEN 1 ELSE 0 END AS st FROM f_preds f, e), q AS (SELECT st, quantile_cont(y - yhat, 0.05) AS l, quantile_cont(y - yhat, 0.95) AS h FROM s WHERE fold <> 0 GROUP BY st) SELECT sample_k, round(yhat + l, 6) AS lo, round(yhat + h, 6) AS hi FROM s JOIN q USING (st) WHERE fold = 0"


@query("M8_quantile_regression", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    return rounded(learn.fit_quantiles(df.where("k % 5 <> 0"), df.where("k % 5 = 0")).select("k", "y", "lo", "yhat", "hi"), 4)


@query("M8_conformal_intervals", "f_preds", sql=CONFORMAL)
def _(p):
    p = p.select("sample_k", "fold", "y", "yhat")
    return rounded(learn.conformal(p.where("fold <> 0"), p.where("fold = 0")).select("sample_k", "lo", "hi"))


@query("M9_grid", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    frames = {"patch": df, "coordinates": learn.vectors(df, F.array("latitude", "longitude"))}
    return rounded(learn.run_grid(frames, {"forest": small_forest, "ridge": learn.MODELS["ridge"]}, [1, 2], "none"), 4)


CV_SCHEMES = ("random", "location")


def cv_preds(s: DataFrame, p: DataFrame, seeds: list[int]) -> DataFrame:
    return learn.evaluate_folds(frame(s, p), {n: folds.SCHEMES[n] for n in CV_SCHEMES}, seeds, small_forest, "none", k=3, with_nn=False)


@query("M10_evaluate_folds", "f_samples", "f_patch")
def _(s, p):
    got = learn.evaluate_folds(frame(s, p), folds.SCHEMES, [1], small_forest, "pca")
    return rounded(got, 4)


@query("I13_cv_report", "f_samples", "f_patch")
def _(s, p):
    return rounded(learn.report_cv(cv_preds(s, p, [1, 2, 3, 4, 5])), 4)


@query("M12_transfer", "f_samples", "f_patch")
def _(s, p):
    return rounded(learn.transfer(frame(s, p), "continent", small_forest, "none", least=20), 4)


@query("M13_cross_year", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    drift = F.transform("vec", lambda v, i: v.cast("double") * F.lit(0.9) + F.sin(i + F.col("k")) * 0.02)
    years = df.withColumn("year", F.lit(2017)).unionByName(learn.vectors(df, drift).withColumn("year", F.lit(2024)))
    return rounded(learn.cross_year(years, 2017, quick_boosted, "none"), 4)


@query("M14_patch_ablation", "f_samples", "f_patch")
def _(s, p):
    return rounded(learn.patch_ablation(folds.random_folds(frame(s, p), 3, 7), "vec", 4, 4, [2, 4], small_forest, "none")[1], 4)


def map_model(pixels: DataFrame):
    from ..operators import raster

    base = learn.vectors(raster.windows(pixels.where("yr = 2017"), 3, ["yr"]), "patch")
    y = F.aggregate("patch", F.lit(0.0), lambda a, v: a + v) / 9
    return learn.fit_pipeline(base.select((F.col("row_i") * 1000 + F.col("col_i")).alias("k"), y.alias("y"), "features"), learn.forest, "none")


@query("M15_predict_map", "f_pixels")
def _(px):
    return rounded(learn.predict_map(px, map_model(px), 3, ["yr"]), 4)


@query("M16_predict_all", "f_pixels")
def _(px):
    path = os.path.join(shared_folder(px.sparkSession), f"maps-{uuid.uuid4().hex}")
    return rounded(learn.predict_all(px, map_model(px), 3, ["tile", "yr"], path), 4)


@query("M18_predict_grid", "f_samples", "f_climate_monthly", "f_pixels")
def _(s, c, px):
    annual = c.groupBy("sample_id").pivot("var", ["prec", "tavg", "wind"]).agg(F.avg("value"))
    train = s.join(annual, "sample_id").select("k", F.col("prec").alias("a"), F.col("wind").alias("b"), (F.col("prec") * 2 - F.col("wind")).alias("y"))
    cells = px.where("yr = 2017").select("row_i", "col_i", F.col("value").alias("a"), F.when(F.col("land_cover_class") != 80, F.col("value") / 2).alias("b"))
    return rounded(learn.predict_grid(train, cells, ["a", "b"], ["row_i", "col_i"], learn.forest), 4)


@query("I12_diagnostics", "f_samples", "f_patch")
def _(s, p):
    df = frame(s, p)
    test, train = df.where("k % 5 = 0"), df.where("k % 5 <> 0")
    preds = held_out(df, learn.forest)[0].select("k", "y", "yhat")
    novelty = neighbours.knn_mean_distance(test, train, 10, "k", "vec").drop("n_neighbours")
    whitened = learn.whitened_distance(test, train).select("k", "whitened")
    near = joins.nn_distance(test, train, "k", "latitude", "longitude")
    crowd = joins.neighbour_counts(df.select("k", "latitude", "longitude"), [25.0], "k", "latitude", "longitude")
    return rounded(learn.diagnostics(preds, novelty, whitened, near, crowd), 4)


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_folder(spark), f"scenes-{uuid.uuid4().hex}")
    columns = {"item_id": "event_id", "dt": "CAST(ts AS TIMESTAMP)", "cloud": "event_id * 17 % 100 * 1e0", "orbit": "CASE event_id % 2 WHEN 0 THEN 'ascending' ELSE 'descending' END"}
    return incremental_scenes(spark, sf_dir, columns, folder, "events.parquet")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_folder(spark), f"scenes-{uuid.uuid4().hex}")
    columns = {"day": "CAST(ts AS DATE)", "pixel": "user_id", "priority": "event_id % 3 * 1000000000000 + event_id", "valid": "coalesce(event_type, '') NOT IN ('error', '')", "b2": "2e2 + event_id * 37 % 900", "b8": "9e2 + event_id * 91 % 3100"}
    picture, cover = incremental_mosaic(spark, sf_dir, columns, folder, ["pixel"], ["b2", "b8"], "events.parquet", least=5.0)
    return picture.join(cover, "day").select("day", "pixel", "b2", "b8", F.round("percent", 6).alias("percent"))


MOSAIC = """WITH o AS (SELECT CAST(ts AS DATE) AS day, user_id AS pixel, event_id % 3 * 1000000000000 + event_id AS priority, coalesce(event_type, '') NOT IN ('error', '') AS valid, 2e2 + event_id * 37 % 900 AS b2, 9e2 + event_id * 91 % 3100 AS b8 FROM events),
m AS (SELECT day, pixel, coalesce(arg_min(b2, priority) FILTER (WHERE valid), 0e0) AS b2, coalesce(arg_min(b8, priority) FILTER (WHERE valid), 0e0) AS b8, bool_or(valid) AS v FROM o GROUP BY day, pixel),
c AS (SELECT day, 100 * avg(CASE WHEN v THEN 1e0 ELSE 0e0 END) AS percent FROM m GROUP BY day)
SELECT day, pixel, b2, b8, round(percent, 6) AS percent FROM m JOIN c USING (day) WHERE percent >= 5"""

QUERIES["X1_incremental_mosaic"] = mosaic
ORACLES["X1_incremental_mosaic"] = MOSAIC
QUERIES["X1_incremental_scenes"] = incremental
ORACLES["X1_incremental_scenes"] = with_views("SELECT CAST(dt AS DATE) AS day, orbit, count(*) AS n, min(cloud) AS clearest FROM f_scenes GROUP BY 1, 2")
