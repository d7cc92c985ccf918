"""Models over spark.ml and the experiments built on them.

Frames have a vector column `features`, a target `y` and an integer key `k`. Fitting loops are short
(models, seeds, folds, domains) and run on the driver; every fit and every transform is a Spark job.
The folds of a scheme are fitted side by side, as each fit is a row of short jobs that leave cores idle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import centre_crop
from ..session import checkpointed
from . import aggregates, filters, folds, joins, ranking, raster
from .quantiles import keyed_quantiles

#: The 13 penalties that ridge chooses from, 1e-2 to 1e4.
ALPHAS = tuple(10 ** (-2 + i / 2) for i in range(13))


#: Fits that run side by side; each keeps its training rows in the executors meanwhile.
FITS = 5

#: Spark's own LAPACK keeps constants in static fields, so decompositions of several threads disturb each other: they may fail to converge, never end or be wrong.
_DECOMPOSING = Lock()


def vectors(df: DataFrame, array: str | Column, out: str = "features") -> DataFrame:
    """df with an array of numbers as a vector."""
    return df.withColumn(out, array_to_vector(F.transform(array, lambda v: v.cast("double"))))


def apply(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the model's results, without its intermediate columns."""
    had = set(df.columns)
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in had])


def fit_scaler(train: DataFrame, column: str = "features", out: str = "scaled", n: int | None = None) -> PipelineModel:
    """Mean 0 and population deviation 1 on the training rows (n, if they are counted); a constant feature becomes 0."""
    n = train.count() if n is None else n
    scaler = StandardScaler(inputCol=column, outputCol=f"__{out}", withMean=True, withStd=True).fit(train)
    stretch = Vectors.dense([math.sqrt(n / max(n - 1, 1))] * scaler.mean.size)
    return PipelineModel([scaler, ElementwiseProduct(scalingVec=stretch, inputCol=f"__{out}", outputCol=out)])


def component_count(wanted: int | None, d: int, n: int) -> int:
    """wanted, or by the rule min(50, d // 10, n // 2); then within 2 and what the data allow."""
    k = min(50, d // 10, n // 2) if wanted is None else wanted
    return min(max(2, k), d, max(2, n - 2))


def fit_pca(train: DataFrame, k: int | None = None, column: str = "features", out: str = "reduced") -> PipelineModel:
    """Principal components of the standardised features; the loading of largest size is positive in each."""
    n = train.count()
    scaler = fit_scaler(train, column, "__z", n)
    scaled = scaler.transform(train)
    with _DECOMPOSING:
        pca = PCA(k=component_count(k, scaler.stages[0].mean.size, n), inputCol="__z", outputCol="__pc").fit(scaled)
    loads = pca.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(loads.shape[1])])
    flip = ElementwiseProduct(scalingVec=Vectors.dense(np.where(signs == 0, 1.0, signs)), inputCol="__pc", outputCol=out)
    return PipelineModel([*scaler.stages, pca, flip])


#: Pluggable reducers: (train, components) -> a model from `features` to `reduced`.
REDUCERS: dict[str, Callable[[DataFrame, int | None], PipelineModel]] = {
    "none": lambda train, k: fit_scaler(train, out="reduced"),
    "pca": lambda train, k: fit_pca(train, k),
}


def whitened_distance(test: DataFrame, train: DataFrame, k: int = 32, out: str = "whitened") -> DataFrame:
    """test with the length of its standardised, whitened components: the distance from the training centre.

    Components without variance are left out; 0 if there are fewer than two components.
    """
    n, d = train.count(), len(train.select("features").first()[0]) if not train.isEmpty() else 0
    if min(k, d, n - 1) < 2:
        return test.withColumn(out, F.lit(0.0))
    model = fit_pca(train, min(k, n - 1))
    var = apply(model, train).select(Summarizer.variance(F.col("reduced")).alias("v")).first()["v"].toArray()
    inverse = F.array(*[F.lit(1 / v if v > 1e-12 else 0.0) for v in map(float, var)])  # k numbers
    squares = F.zip_with(vector_to_array("reduced"), inverse, lambda s, w: s * s * w)
    return apply(model, test).withColumn(out, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, v: a + v))).drop("reduced")


class Ridge:
    """Least squares with the penalty whose leave-one-out error is smallest (the smallest penalty of equals).

    One pass gives the moments (features squared numbers, whatever the rows), a second the exact
    leave-one-out errors of all penalties, a third fits the chosen one.
    """

    def __init__(self, alphas: tuple[float, ...] = ALPHAS, column: str = "reduced"):
        self.alphas, self.column = alphas, column

    def errors(self, train: DataFrame) -> dict[float, float]:
        """The sum of squared leave-one-out errors of each penalty."""
        both = VectorAssembler(inputCols=[self.column, "y"], outputCol="__xy").transform(train.withColumn("y", F.col("y").cast("double")))
        s = both.select(Summarizer.metrics("mean", "std", "count").summary(F.col("__xy")).alias("s")).first()["s"]
        n, mean, sd = s["count"], s["mean"].toArray(), s["std"].toArray() * math.sqrt(max(s["count"] - 1, 1) / s["count"])
        moments = np.nan_to_num(Correlation.corr(both, "__xy").first()[0].toArray()) * np.outer(sd, sd) * n
        gram, cross = moments[:-1, :-1], moments[:-1, -1]
        inverses = [np.linalg.inv(gram + a * np.eye(len(gram))) for a in self.alphas]
        shared = train.sparkSession.sparkContext.broadcast((mean, cross, inverses))

        def summed(parts):
            mean, cross, inverses = shared.value
            total = np.zeros(len(inverses))
            for p in parts:
                if len(p):
                    x = np.stack(p["x"].to_numpy()) - mean
                    x, y = x[:, :-1], x[:, -1]
                    for i, inv in enumerate(inverses):
                        h = ((x @ inv) * x).sum(1) + 1 / n
                        total[i] += (((y - x @ (inv @ cross)) / np.maximum(1 - h, 1e-12)) ** 2).sum()
            yield pd.DataFrame({"i": range(len(total)), "sse": total})

        rows = both.select(vector_to_array("__xy").alias("x")).mapInPandas(summed, "i int, sse double").groupBy("i").agg(F.sum("sse").alias("sse"))
        return {self.alphas[r["i"]]: r["sse"] for r in rows.orderBy("i").collect()}

    def fit(self, train: DataFrame):
        errors = self.errors(train)
        alpha = min(errors, key=lambda a: (errors[a], a))
        r = train.agg(F.stddev_pop("y").alias("sd"), F.count("y").alias("n")).first()
        # Spark scales the target by its deviation, so the penalty is scaled alike.
        penalty = alpha * (r["sd"] or 1.0) / r["n"]
        return LinearRegression(featuresCol=self.column, labelCol="y", predictionCol="yhat", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def forest(seed: int, trees: int = 100, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="reduced", labelCol="y", predictionCol="yhat", numTrees=trees, maxDepth=depth, seed=seed)


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether the rule has stopped): the round of least error before `patience` rounds in a row without a lower one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


class PatientBoosting:
    """Boosted trees, stopped when the validation rows' squared error has not fallen for `patience` rounds, with the rounds up to the best one.

    Rounds are fitted in stages, each twice as long as the one before; a fit with the same seed begins
    with the same trees, so every stage repeats the last one and goes on, and the model is cut by
    fitting the best number of rounds. Without validation rows all rounds are fitted.
    """

    def __init__(self, seed: int, rounds: int = 1000, step: float = 0.05, depth: int = 4, patience: int = 15, first: int = 32):
        self.patience, self.rounds, self.first = patience, rounds, first
        self.of = lambda n: GBTRegressor(featuresCol="reduced", labelCol="y", predictionCol="yhat", maxIter=n, stepSize=step, maxDepth=depth, subsamplingRate=0.8, seed=seed)

    def fit(self, train: DataFrame):
        rows, shown = checkpointed(train.where(~F.col("validation"))), checkpointed(train.where("validation"))
        if shown.isEmpty():
            return self.of(self.rounds).fit(rows)
        n = min(self.first, self.rounds)
        while True:
            model = self.of(n).fit(rows)
            kept, stopped = best_round(list(model.evaluateEachIteration(shown, "squared")), self.patience)
            if stopped or n >= self.rounds:
                return model if kept == n else self.of(kept).fit(rows)
            n = min(2 * n, self.rounds)


def boosted(seed: int, rounds: int = 1000, step: float = 0.05, depth: int = 4, patience: int = 15) -> PatientBoosting:
    return PatientBoosting(seed, rounds, step, depth, patience)


class QuantileRegression:
    """Linear quantiles of y in `reduced`, by the pinball loss smoothed with a normal kernel.

    The kernel's width falls with the rows (He and others, Smoothed quantile regression with
    large-scale inference), so the smoothed loss is convex and twice differentiable and Newton's
    steps find its least value. In each step the tasks add up gradient and curvature of their rows, for
    all quantiles at once; features squared numbers come back, whatever the rows.
    """

    def __init__(self, qs: tuple[float, ...] = (0.05, 0.5, 0.95), column: str = "reduced", steps: int = 30, tolerance: float = 1e-6):
        self.qs, self.column, self.steps, self.tolerance = qs, column, steps, tolerance

    def fit(self, train: DataFrame) -> np.ndarray:
        """Coefficients, the constant first, a row for each quantile."""
        rows = checkpointed(train.select(vector_to_array(self.column).alias("x"), F.col("y").cast("double").alias("y")).where("y is not null"))
        n, mean, sd = rows.agg(F.count("y"), F.avg("y"), F.stddev_pop("y")).first()
        d = len(rows.first()["x"]) + 1 if n else 0
        if not n:
            raise ValueError("no rows to fit")
        scale = sd or 1.0
        width = scale * max(0.05, ((math.log(n) + d) / n) ** 0.4)
        start = np.zeros((len(self.qs), d))
        start[:, 0] = mean
        beta = start
        loss, gradient, curvature = self._sums(rows, beta, width)
        for _ in range(self.steps):
            step = np.stack([np.linalg.solve(h + 1e-8 * np.trace(h) / d * np.eye(d) + 1e-12 * np.eye(d), g) for g, h in zip(gradient, curvature, strict=True)])
            share = np.ones(len(self.qs))
            for _ in range(12):  # a step is halved until the loss falls
                tried = beta - share[:, None] * step
                after = self._sums(rows, tried, width)
                worse = after[0] > loss + 1e-12 * np.abs(loss)
                if not worse.any():
                    break
                share = np.where(worse, share / 2, share)
            else:
                break
            fell = (loss - after[0]) / np.maximum(np.abs(loss), 1e-12)
            beta, (loss, gradient, curvature) = tried, after
            if (fell < self.tolerance).all():
                break
        return beta

    def _sums(self, rows: DataFrame, beta: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(losses, gradients, curvatures) of the smoothed pinball loss at beta, of each quantile."""
        qs, d = np.array(self.qs), beta.shape[1]
        shape = (len(qs), 1 + d + d * d)

        def summed(parts):
            total = np.zeros(shape)
            for p in parts:
                if not len(p):
                    continue
                x = np.column_stack([np.ones(len(p)), np.stack(p["x"].to_numpy())])
                for i, q in enumerate(qs):
                    e = (p["y"].to_numpy() - x @ beta[i]) / width
                    density = np.exp(-0.5 * e * e) / math.sqrt(2 * math.pi)
                    below = _normal_below(-e)
                    total[i, 0] += width * (density + e * (q - below)).sum()
                    total[i, 1 : 1 + d] += x.T @ (below - q)
                    total[i, 1 + d :] += ((x * (density / width)[:, None]).T @ x).ravel()
            yield pd.DataFrame({"i": np.repeat(np.arange(shape[0]), shape[1]), "j": np.tile(np.arange(shape[1]), shape[0]), "s": total.ravel()})

        out = np.zeros(shape)
        for r in rows.mapInPandas(summed, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            out[r["i"], r["j"]] = r["s"]
        return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(-1, d, d)


def _normal_below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by the error function of Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


def fit_quantiles(train: DataFrame, test: DataFrame, qs: tuple[float, float, float] = (0.05, 0.5, 0.95), reducer: str = "pca", k: int | None = None) -> DataFrame:
    """test with lo, yhat and hi: quantile regressions on the reduced features of train, fitted by the pinball loss; lo and hi change places where they cross."""
    reduced = REDUCERS[reducer](train, k)
    beta = QuantileRegression(qs).fit(apply(reduced, train))
    got = apply(reduced, test)
    x = vector_to_array("reduced")
    at = lambda b: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in b[1:]]), lambda u, v: u * v), F.lit(float(b[0])), lambda s, v: s + v)
    low, middle, high = (at(b) for b in beta)
    return got.withColumns({"lo": F.least(low, high), "yhat": middle, "hi": F.greatest(low, high)}).drop("reduced")


#: Pluggable models: seed -> something with fit(train).
MODELS: dict[str, Callable[[int], object]] = {"forest": forest, "boosted": boosted, "ridge": lambda seed: Ridge()}


def fit_pipeline(train: DataFrame, model: Callable[[int], object] | str = "boosted", reducer: str = "pca", k: int | None = None, seed: int = 1, reduced: PipelineModel | None = None) -> PipelineModel:
    """Scaler, reducer and model as one PipelineModel, which can be written and read.

    The reducer is fitted on the training rows, or given as reduced (of all rows: a diagnostic that
    leaks). An eighth of the training rows, by a hash of k, shows boosted trees when to stop.
    """
    reduced = REDUCERS[reducer](train, k) if reduced is None else reduced
    make = MODELS[model] if isinstance(model, str) else model
    rows = checkpointed(apply(reduced, train).select("k", "y", "reduced", (F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(8)) == 0).alias("validation")))
    fitted = make(seed).fit(rows)
    return PipelineModel([*reduced.stages, fitted])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with yhat."""
    return apply(model, df).drop("reduced")


def importances(model: PipelineModel) -> np.ndarray:
    """The tree model's importance of each reduced feature."""
    return model.stages[-1].featureImportances.toArray()


def conformal(calibration: DataFrame, preds: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """preds with lo and hi: the prediction plus quantiles of the calibration rows' residuals.

    The quantiles are those of the prediction's stratum, by quartiles of the calibration rows'
    predictions. This stands in for a quantile objective, which spark.ml has not.
    """
    edges = ranking.quantiles(calibration, "yhat", [0.25, 0.5, 0.75])
    stratum = sum((F.coalesce((F.col("yhat") > F.lit(e)).cast("int"), F.lit(0)) for e in edges), F.lit(0))
    placed = lambda df: df.withColumn("__s", stratum)
    q = keyed_quantiles(placed(calibration), ["__s"], F.col("y") - F.col("yhat"), [low, high]).withColumnRenamed("q", "__q")  # four rows
    out = placed(preds).join(F.broadcast(q), "__s", "left")
    return out.withColumns({"lo": F.col("yhat") + F.col("__q")[0], "hi": F.col("yhat") + F.col("__q")[1]}).drop("__s", "__q")


def run_grid(frames: dict[str, DataFrame], models: dict[str, Callable[[int], object]], seeds: list[int], reducer: str = "pca", k: int | None = None) -> DataFrame:
    """(config, model, run_seed, r2, rmse, mae, medae, me, n, error): each model on each feature set and seed.

    A run splits its frame by a hash of k and the seed. A failed run is a row with the error. Each
    run keeps its predictions, and all are measured together.
    """
    runs, parts, spark = [], [], next(iter(frames.values())).sparkSession
    for config, df in frames.items():
        for seed in seeds:
            split = folds.split3(df, seed)
            train, test = checkpointed(split.where("split <> 'test'")), split.where("split = 'test'")
            for name, make in models.items():
                error = None
                try:
                    got = predict(fit_pipeline(train, make, reducer, k, seed), test)
                    parts.append(checkpointed(got.select(F.lit(len(runs)).alias("__run"), "y", "yhat")))
                except Exception as e:  # noqa: BLE001 - the failure is the run's result
                    error = f"{type(e).__name__}: {e}".splitlines()[0][:200]
                runs.append((config, name, seed, error))
    found = {m["__run"]: m for m in aggregates.regression_metrics(reduce(DataFrame.unionByName, parts), ["__run"]).collect()} if parts else {}  # a row for each run
    rows = []
    for i, (config, name, seed, error) in enumerate(runs):
        m = found.get(i)
        none = [None] * 5 + [None if error else 0]  # no row to test
        rows.append((config, name, seed, *([m[c] for c in ("r2", "rmse", "mae", "medae", "me", "n")] if m else none), error))
    return spark.createDataFrame(rows, "config string, model string, run_seed int, r2 double, rmse double, mae double, medae double, me double, n long, error string")


def cross_predict(df: DataFrame, model: Callable[[int], object] | str, reducer: str = "pca", k: int | None = None, seed: int = 1, scope: str = "in_fold", with_nn: bool = False, least: int = 10) -> DataFrame:
    """Out-of-sample predictions of a frame with a fold column: df without features, with yhat (and nn_km).

    Folds with fewer than least rows on either side are left out. scope "global" fits the reducer
    on all rows, once. with_nn adds the distance to the nearest training place.
    """
    sizes = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each fold
    total = sum(sizes.values())
    usable = sorted(f for f in sizes if f is not None and sizes[f] >= least and total - sizes[f] >= least)
    shared = REDUCERS[reducer](df, k) if scope == "global" and usable else None
    if not usable:
        return df.drop("features").withColumn("yhat", F.lit(None).cast("double")).limit(0)

    def predicted(fold) -> DataFrame:
        train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        return predict(fit_pipeline(train, model, reducer, k, seed, shared), test).drop("features")

    own = lambda fold: inheritable_thread_target(df.sparkSession)(lambda: predicted(fold))  # noqa: E731 - properties of its own for each thread
    with ThreadPool(min(FITS, len(usable))) as pool:
        parts = pool.map(lambda job: job(), [own(f) for f in usable])
    out = reduce(DataFrame.unionByName, parts)
    if with_nn:
        out = out.join(joins.nn_other_group(df, "fold", "k", "latitude", "longitude"), "k", "left")
    return checkpointed(out)


def evaluate_folds(df: DataFrame, schemes: dict[str, Callable[[DataFrame, int, int], DataFrame]], seeds: list[int], model: Callable[[int], object] | str = "boosted", reducer: str = "pca", components: int | None = None, k: int = 5, scope: str = "in_fold", with_nn: bool = True) -> DataFrame:
    """(scheme, seed, fold, k, y, yhat, nn_km) of every scheme and seed; schemes map (df, folds, seed) to df with fold."""
    parts = []
    for name, scheme in schemes.items():
        for seed in seeds:
            folded = checkpointed(scheme(df, k, seed).select("k", "latitude", "longitude", "features", "y", "fold"))
            got = cross_predict(folded, model, reducer, components, seed, scope, with_nn)
            parts.append(got.select(F.lit(name).alias("scheme"), F.lit(seed).alias("seed"), "fold", "k", "y", "yhat", *(["nn_km"] if with_nn and "nn_km" in got.columns else [])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def oof_mean(preds: DataFrame, keys: list[str], p: str = "yhat") -> DataFrame:
    """Predictions averaged over seeds."""
    return preds.groupBy(*keys).agg(F.avg(p).alias(p))


def report_cv(preds: DataFrame) -> DataFrame:
    """(scheme, r2, r2_sd, rmse, n): means over seeds of what all folds of a seed give together."""
    runs = aggregates.regression_metrics(preds, ["scheme", "seed"])
    return runs.groupBy("scheme").agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("r2_sd"), F.avg("rmse").alias("rmse"), F.sum("n").alias("n"))


def transfer(df: DataFrame, domain: str, model: Callable[[int], object] | str = "boosted", reducer: str = "pca", k: int | None = None, seed: int = 1, least: int = 30) -> DataFrame:
    """(source, target, r2, rmse, n, rho, transfer_drop): fitted on one domain, scored on each other.

    For source = target a fifth of the domain is held out; rho is Spearman's; transfer_drop is a
    target's r2 less that of its own model. Domains with fewer than least rows are left out.
    """
    names = sorted(r[domain] for r in filters.guard(df.where(F.col(domain).isNotNull()), [domain], least).select(domain).collect())  # few by their nature
    split, parts = checkpointed(folds.split_within(df, domain, seed)), []
    for name in names:
        own = split.where(F.col(domain) == name)
        for rows, held in ((own, split.where((F.col(domain) != name) & F.col(domain).isin(names))), (own.where("split = 'train'"), own.where("split = 'test'"))):
            got = predict(fit_pipeline(rows, model, reducer, k, seed), held)
            parts.append(got.select(F.lit(name).alias("source"), F.col(domain).alias("target"), "y", "yhat"))
    if not parts:
        return df.sparkSession.createDataFrame([], "source string, target string, r2 double, rmse double, n long, rho double, transfer_drop double")
    preds, pair = checkpointed(reduce(DataFrame.unionByName, parts)), ["source", "target"]
    m = aggregates.regression_metrics(preds, pair).select(*pair, "r2", "rmse", "n").join(ranking.spearman(preds, "y", "yhat", pair), pair)
    own = m.where("source = target").select("target", F.col("r2").alias("__own"))
    return m.join(own, "target", "left").withColumn("transfer_drop", F.col("r2") - F.col("__own")).select(*pair, "r2", "rmse", "n", "rho", "transfer_drop")


def cross_year(df: DataFrame, base_year: int, model: Callable[[int], object] | str = "boosted", reducer: str = "pca", k: int | None = None, seed: int = 1, year: str = "year") -> DataFrame:
    """(year, r2, n, r, mad): a model of the base year's features scored on every year's features of the same held-out keys.

    r and mad compare a year's predictions with the base year's.
    """
    split = checkpointed(folds.split3(df, seed))
    fitted = fit_pipeline(split.where((F.col(year) == base_year) & (F.col("split") != "test")), model, reducer, k, seed)
    preds = checkpointed(predict(fitted, split.where("split = 'test'")).select(year, "k", "y", "yhat"))
    base = preds.where(F.col(year) == base_year).select("k", F.col("yhat").alias("__b"))
    same = preds.join(base, "k")
    stable = same.groupBy(year).agg(F.corr("yhat", "__b").alias("r"), F.avg(F.abs(F.col("yhat") - F.col("__b"))).alias("mad"))
    return aggregates.regression_metrics(same, [year]).select(year, "r2", "n").join(stable, year)


def patch_ablation(df: DataFrame, patch: str, p: int, c: int, sizes: list[int], model: Callable[[int], object] | str = "boosted", reducer: str = "pca", k: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(preds, metrics by size): central q x q crops of a p x p x c patch on the frame's own folds, the same for each size."""
    parts = []
    for q in sizes:
        cropped = checkpointed(vectors(df, centre_crop(F.col(patch), p, q, c)).select("k", "y", "fold", "features"))
        parts.append(cross_predict(cropped, model, reducer, k, seed).withColumn("size", F.lit(q)))
    preds = reduce(DataFrame.unionByName, parts)
    return preds, aggregates.regression_metrics(preds, ["size"])


def predict_map(pixels: DataFrame, model: PipelineModel, size: int, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, row_i, col_i, yhat) of each pixel with a complete window; border pixels and those beside missing ones have none."""
    w = vectors(raster.windows(pixels, size, keys, value), "patch")
    return predict(model, w).select(*keys, "row_i", "col_i", "yhat")


def predict_all(pixels: DataFrame, model: PipelineModel, size: int, keys: list[str], path: str, value: str = "value") -> DataFrame:
    """Maps of all keys (area and year), written partitioned by them; keys already in the folder are not computed again."""
    spark = pixels.sparkSession
    todo = pixels
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # noqa: BLE001 - only a folder that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        same = reduce(lambda a, b: a & b, [pixels[x].cast("string") == done[x].cast("string") for x in keys])
        todo = pixels.join(done, same, "left_anti")
    predict_map(todo, model, size, keys, value).write.mode("append").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)


def predict_grid(train: DataFrame, cells: DataFrame, columns: list[str], at: list[str], model: Callable[[int], object] | str = "boosted", seed: int = 1) -> DataFrame:
    """Every cell with yhat of a model on a few columns; training rows and cells with a null among them take no part, such cells get null."""
    rows = lambda df: VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna("any", subset=columns))
    fitted = fit_pipeline(rows(train.where("y IS NOT NULL")).select("k", "y", "features"), model, "none", None, seed)
    return cells.select(*at).join(predict(fitted, rows(cells)).select(*at, "yhat"), at, "left")


def diagnostics(preds: DataFrame, *tables: DataFrame, key: str = "k") -> DataFrame:
    """One row for each predicted sample with whatever the tables say of it (novelty, distances, densities)."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, preds)
