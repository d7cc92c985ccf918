"""Models against numpy, experiments by their bounds, neighbours and streams by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import folds, learn, neighbours
from siteweave.streaming.scenes import incremental_scenes


def latent(spark, n=260, seed=0):
    """The synthetic case: four hidden numbers, seen through noisy copies, drive the target."""
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 4))
    x = np.repeat(z, 4, axis=1) * 0.5 + r.normal(size=(n, 16)) * 0.1
    y = 100 + 30 * z[:, 0] - 20 * z[:, 1] + r.normal(size=n) * 5
    rows = [(i, float(45 + i % 15), float(5 + i % 20), x[i].tolist(), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, latitude double, longitude double, vec array<double>, y double")
    return learn.vectors(df, "vec").cache(), x, y


def column(df, name):
    return np.array([r[name] for r in df.orderBy("k").select(name).collect()])


def test_scaler_and_pca_equal_numpy(spark):
    df, x, _ = latent(spark)
    z = (x - x.mean(0)) / x.std(0)
    got = np.array([r[0].toArray() for r in learn.apply(learn.fit_scaler(df), df).orderBy("k").select("scaled").collect()])
    assert np.allclose(got, z)
    w, v = np.linalg.eigh(np.cov(z.T))
    v = v[:, ::-1][:, :3]
    v = v * np.sign(v[np.abs(v).argmax(0), range(3)])
    got = np.array([r[0].toArray() for r in learn.apply(learn.fit_pca(df, 3), df).orderBy("k").select("reduced").collect()])
    assert np.allclose(got, z @ v, atol=1e-6)
    white = np.sqrt((((z @ v) / np.sqrt(w[::-1][:3])) ** 2).sum(1))
    assert np.allclose(column(learn.whitened_distance(df, df, 3), "whitened"), white, atol=1e-6)


def test_ridge_equals_closed_form(spark):
    df, x, y = latent(spark)
    rows = df.withColumn("reduced", F.col("features"))
    errors = learn.Ridge().errors(rows)
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (learn.ALPHAS[0], learn.ALPHAS[6], learn.ALPHAS[12]):
        hat = xc @ np.linalg.inv(xc.T @ xc + alpha * np.eye(16)) @ xc.T
        assert np.isclose(errors[alpha], (((yc - hat @ yc) / (1 - np.diag(hat) - 1 / len(y))) ** 2).sum(), rtol=1e-6)
    alpha = min(errors, key=errors.get)
    beta = np.linalg.inv(xc.T @ xc + alpha * np.eye(16)) @ xc.T @ yc
    assert np.allclose(learn.Ridge().fit(rows).coefficients.toArray(), beta, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("name", ["forest", "boosted", "ridge"])
def test_models_explain_the_target(spark, name):
    df, _, _ = latent(spark)
    make = {"forest": lambda s: learn.forest(s, 20, 6), "boosted": lambda s: learn.boosted(s, 30, 0.2), "ridge": learn.MODELS["ridge"]}[name]
    preds = learn.predict(learn.fit_pipeline(df.where("k < 180"), make, "pca", 4), df.where("k >= 180"))
    y, p = column(preds, "y"), column(preds, "yhat")
    assert 0.3 < 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() < 1


def test_grid_keeps_failures_and_folds_cover_all_rows(spark):
    df, _, _ = latent(spark)

    def broken(seed):
        raise ValueError("no model")

    rows = learn.run_grid({"a": df}, {"ridge": learn.MODELS["ridge"], "broken": broken}, [1], "none").collect()
    assert {r["model"]: r["error"] for r in rows} == {"ridge": None, "broken": "ValueError: no model"}
    preds = learn.evaluate_folds(df, {"random": folds.SCHEMES["random"]}, [3], "ridge", "none", k=3, with_nn=False)
    assert sorted(r["k"] for r in preds.collect()) == list(range(260))
    assert learn.cross_predict(df.withColumn("fold", F.lit(0)), "ridge", "none").count() == 0


def metrics(pairs):
    y, p = (np.array(v) for v in zip(*pairs, strict=True))
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.sqrt(((y - p) ** 2).mean())


def test_reducer_scopes_differ_in_what_they_see(spark):
    df, x, y = latent(spark)
    folded = df.withColumn("fold", F.pmod("k", F.lit(3)))
    own, all_ = (column(learn.cross_predict(folded, "ridge", "pca", 4, 1, s), "yhat") for s in ("in_fold", "global"))
    z = (x - x.mean(0)) / x.std(0)
    first = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :4]
    r = z @ first
    want = np.empty(len(y))
    for f in range(3):
        a, b = np.arange(260) % 3 != f, np.arange(260) % 3 == f
        m = r[a].mean(0)
        # The smallest penalties are chosen here, so least squares is what both come near.
        want[b] = y[a].mean() + (r[b] - m) @ np.linalg.lstsq(r[a] - m, y[a] - y[a].mean(), rcond=None)[0]
    assert np.abs(all_ - want).max() < 2.0
    assert not np.allclose(own, all_) and np.corrcoef(own, all_)[0, 1] > 0.98


def test_report_averages_what_each_seed_gives(spark):
    rng = np.random.default_rng(2)
    rows = [(s, seed, i % 3, float(v), float(v + rng.normal())) for s in ("a", "b") for seed in (1, 2, 3) for i, v in enumerate(rng.normal(size=30) * 3)]
    got = {r["scheme"]: r for r in learn.report_cv(spark.createDataFrame(rows, "scheme string, seed int, fold int, y double, yhat double")).collect()}
    for s in ("a", "b"):
        runs = [metrics([(r[3], r[4]) for r in rows if r[:2] == (s, seed)]) for seed in (1, 2, 3)]
        assert np.isclose(got[s]["r2"], np.mean([r[0] for r in runs])) and np.isclose(got[s]["r2_sd"], np.std([r[0] for r in runs]))
        assert np.isclose(got[s]["rmse"], np.mean([r[1] for r in runs])) and got[s]["n"] == 90


def test_transfer_scores_every_pair_of_domains(spark):
    df, _, _ = latent(spark)
    named = df.withColumn("domain", F.when(F.col("k") < 120, "a").when(F.col("k") < 240, "b").when(F.col("k") < 250, "small"))
    flipped = named.withColumn("y", F.when(F.col("domain") == "b", 200 - F.col("y")).otherwise(F.col("y")))
    got = {(r["source"], r["target"]): r for r in learn.transfer(flipped, "domain", "ridge", "none").collect()}
    assert set(got) == {(a, b) for a in "ab" for b in "ab"}
    assert got["a", "a"]["r2"] > 0.8 and got["a", "b"]["r2"] < 0 and got["a", "b"]["n"] == 120
    assert all(np.isclose(r["transfer_drop"], r["r2"] - got[t, t]["r2"]) for (_, t), r in got.items())
    assert learn.transfer(flipped.where("domain = 'small'"), "domain", "ridge", "none").count() == 0


def test_years_are_scored_on_the_same_rows(spark):
    df, _, _ = latent(spark)
    shifted = learn.vectors(df, F.transform("vec", lambda v: v + 0.1))
    years = df.withColumn("year", F.lit(2017)).unionByName(shifted.withColumn("year", F.lit(2024)))
    got = {r["year"]: r for r in learn.cross_year(years, 2017, "ridge", "none").collect()}
    assert got[2017]["n"] == got[2024]["n"] and np.isclose(got[2017]["r"], 1) and got[2017]["mad"] == 0
    # A linear model moves all predictions alike.
    assert np.isclose(got[2024]["r"], 1) and got[2024]["mad"] > 0 and got[2024]["r2"] <= got[2017]["r2"] + 0.05


def test_ablation_crops_the_middle(spark):
    rng = np.random.default_rng(3)
    patches = rng.normal(size=(200, 4, 4, 2))
    y = patches[:, 1:3, 1:3].sum(axis=(1, 2, 3))
    rows = [(i, i % 4, patches[i].ravel().tolist(), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, fold int, patch array<double>, y double")
    preds, found = learn.patch_ablation(df, "patch", 4, 2, [2, 4], "ridge", "none")
    r2 = {r["size"]: r["r2"] for r in found.collect()}
    assert preds.count() == 400 and r2[2] > 0.99 and r2[4] > 0.95


def test_maps_cover_the_inner_pixels(spark):
    from siteweave.operators import raster

    value = np.random.default_rng(4).normal(size=(7, 6))
    value[2, 2] = np.nan
    cells = [(1, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(value)]
    pixels = spark.createDataFrame(cells, "yr int, row_i long, col_i long, value double")
    base = learn.vectors(raster.windows(pixels, 3, ["yr"]), "patch").select((F.col("row_i") * 10 + F.col("col_i")).alias("k"), F.col("patch")[4].alias("y"), "features")
    got = learn.predict_map(pixels, learn.fit_pipeline(base, learn.MODELS["ridge"], "none"), 3, ["yr"]).collect()
    want = {(r, c) for r in range(1, 6) for c in range(1, 5) if not np.isnan(value[r - 1 : r + 2, c - 1 : c + 2]).any()}
    assert {(r["row_i"], r["col_i"]) for r in got} == want and len(got) == len(want)


def test_diagnostics_keep_every_prediction(spark):
    preds = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "k long, yhat double")
    a, b = spark.createDataFrame([(1, 0.5)], "k long, novelty double"), spark.createDataFrame([(2, 7), (9, 8)], "k long, near int")
    got = [tuple(r) for r in learn.diagnostics(preds, a, b).orderBy("k").collect()]
    assert got == [(1, 2.0, 0.5, None), (2, 3.0, None, 7), (3, None, None, None)]


def test_grid_cells_with_nulls_have_no_prediction(spark):
    train = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(40)] + [(99, None, 5.0)], "k long, a double, y double")
    cells = spark.createDataFrame([(1, 3.0), (2, None), (2, None)], "cell int, a double")
    got = learn.predict_grid(train, cells, ["a"], ["cell"], "ridge").collect()
    assert len(got) == 3 and all((r["yhat"] is None) == (r["cell"] == 2) for r in got)


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(60, 5)), r.normal(size=(90, 5))
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vec array<double>")
    want = np.sort(np.sqrt(((x[:, None] - y) ** 2).sum(2)), axis=1)[:, :10].mean(1)
    got = neighbours.knn_mean_distance(frame(x), frame(y), 10, rows=16).orderBy("id").collect()
    assert np.allclose([g["mean_distance"] for g in got], want)
    few = neighbours.knn_mean_distance(frame(x[:2]), frame(y[:3]), 10).collect()
    assert [g["n_neighbours"] for g in few] == [3, 3]
    none = neighbours.knn_mean_distance(frame(x[:2]), frame(y).limit(0), 10).collect()
    assert [(g["mean_distance"], g["n_neighbours"]) for g in none] == [(None, 0)] * 2


def test_scenes_count_once_over_runs(spark, tmp_path):
    columns = {"item_id": "item_id", "dt": "CAST(dt AS TIMESTAMP)", "cloud": "cloud", "orbit": "orbit"}
    arrive = lambda rows: spark.createDataFrame(rows, "item_id long, dt string, cloud double, orbit string").write.mode("append").parquet(str(tmp_path / "in"))
    arrive([(1, "2024-01-01", 5.0, "up"), (1, "2024-01-01", 5.0, "up"), (2, "2024-01-01", 3.0, None)])
    run = lambda: {(str(r["day"]), r["orbit"]): (r["n"], r["clearest"]) for r in incremental_scenes(spark, str(tmp_path / "in"), columns, str(tmp_path / "out")).collect()}
    assert run() == {("2024-01-01", "up"): (1, 5.0), ("2024-01-01", "unknown"): (1, 3.0)}
    arrive([(1, "2024-01-01", 5.0, "up"), (3, "2024-01-01", 1.0, "up")])
    assert run() == {("2024-01-01", "up"): (2, 1.0), ("2024-01-01", "unknown"): (1, 3.0)}
    assert run()[("2024-01-01", "up")] == (2, 1.0)


def test_maps_are_written_once(spark, tmp_path):
    pixels = spark.createDataFrame([(2017 + t, r, c, float(r + c)) for t in range(2) for r in range(8) for c in range(8)], "yr int, row_i long, col_i long, value double")
    from siteweave.operators import raster

    base = learn.vectors(raster.windows(pixels, 3, ["yr"]), "patch").select((F.col("row_i") * 10 + F.col("col_i")).alias("k"), F.col("patch")[4].alias("y"), "features")
    model = learn.fit_pipeline(base, "ridge", "none")
    path = str(tmp_path / "maps")
    assert learn.predict_all(pixels.where("yr = 2017"), model, 3, ["yr"], path).count() == 36
    assert learn.predict_all(pixels, model, 3, ["yr"], path).count() == 72


def test_frames_are_joined_once_and_runs_measured_together(spark, monkeypatch):
    from siteweave.operators import aggregates
    from siteweave.plans.fixtures import view
    from siteweave.plans.learning import frame

    df = frame(*[view(spark, "/root/testdata/sf0.001", v) for v in ("f_samples", "f_patch")])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    calls, metrics = [], aggregates.regression_metrics
    monkeypatch.setattr(aggregates, "regression_metrics", lambda *a: calls.append(a) or metrics(*a))
    rows = learn.run_grid({"a": df, "b": df}, {"ridge": learn.MODELS["ridge"]}, [1, 2], "none").collect()
    assert len(calls) == 1 and [(r["config"], r["run_seed"]) for r in rows] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert rows[0]["r2"] == pytest.approx(rows[2]["r2"]) and rows[0]["n"] == df.where("true").transform(lambda d: learn.folds.split3(d, 1)).where("split = 'test'").count()
    fits = []
    monkeypatch.setitem(learn.REDUCERS, "pca", lambda train, k: fits.append(k) or learn.fit_pca(train, k))
    assert learn.cross_predict(learn.folds.random_folds(df, 3, 7), "ridge", "pca", 4, 1, "global").count() == df.count() and len(fits) == 1
