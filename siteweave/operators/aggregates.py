"""Group statistics, pivots, metrics and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .quantiles import keyed_quantiles, with_quantiles


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median, quartiles, count, mean, sample deviation and interquartile range of each group."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    q = with_quantiles(g, df, [key], value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return q.select(key, "median", "q25", "q75", "n", "mean", "sd", (F.col("q75") - F.col("q25")).alias("iqr"))


def iqr_filter(df: DataFrame, key: str, value: str, k: float = 5.0, drop_unassigned: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed, counts): removed rows exceed their group's median by more than k interquartile ranges."""
    assigned = df.where(F.col(key).isNotNull()) if drop_unassigned else df
    limits = group_stats(df.where(F.col(key).isNotNull()), key, value).select(key, (F.col("median") + k * F.col("iqr")).alias("__limit"))
    marked = assigned.join(limits, key, "left").withColumn("__out", F.coalesce(F.col(value) > F.col("__limit"), F.lit(False)))
    counts = marked.groupBy(key).agg(F.count_if("__out").alias("removed"), F.count(F.lit(1)).alias("total"))
    return marked.where("not __out").select(*df.columns), marked.where("__out").select(*df.columns), counts


def annual_summary(monthly: DataFrame, key: str = "sample_id", var: str = "var", value: str = "value") -> DataFrame:
    """Mean, least and greatest of the months that have a value; a variable without any gives no row."""
    return monthly.where(F.col(value).isNotNull()).groupBy(key, var).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("sd"))


#: What raw soil numbers are divided by; variables that are not listed by 10.
SOIL_FACTORS = {"nitrogen": 100.0}


def soil_features(raw: DataFrame, layered: list[str], key: str = "sample_id") -> DataFrame:
    """soil_<var>_<depth> in units and soil_<var>_gradient (top less sub; null if either is), from (key, var, depth, raw)."""
    out = []
    for v in layered:
        at = lambda d, v=v: F.max(F.when((F.col("var") == v) & (F.col("depth") == d), F.col("raw"))) / SOIL_FACTORS.get(v, 10.0)
        out += [at("0_5cm").alias(f"soil_{v}_0_5cm"), at("5_15cm").alias(f"soil_{v}_5_15cm")]
    wide = raw.groupBy(key).agg(*out, F.max(F.when(F.col("var") == "wrb", F.col("raw"))).alias("soil_wrb"))
    return wide.withColumns({f"soil_{v}_gradient": F.col(f"soil_{v}_0_5cm") - F.col(f"soil_{v}_5_15cm") for v in layered})


def one_hot(df: DataFrame, column: str, prefix: str, vocabulary: list, missing: str = "zeros") -> DataFrame:
    """0/1 columns of a fixed vocabulary.

    A missing category is 0 in all of them ("zeros"), has a column of its own, named -1 ("class", for
    soil types), or no row ("drop", for land cover). A category out of the vocabulary is 0 in all.
    """
    if missing not in ("zeros", "class", "drop"):
        raise ValueError(missing)
    out = df.where(F.col(column).isNotNull()) if missing == "drop" else df
    more = {f"{prefix}-1": F.col(column).isNull().cast("double")} if missing == "class" else {}
    return out.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0)) for v in vocabulary} | more)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column become the column's mean; a column of nulls stays."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])  # one row


def regression_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "yhat") -> DataFrame:
    """R2, RMSE, MAE, median absolute error and mean error (prediction less observation)."""
    d = F.col(p) - F.col(y)
    got = preds.groupBy(*keys).agg(
        (1 - F.try_divide(F.sum(d * d), F.nullif(F.regr_syy(F.col(y), F.col(y)), F.lit(0.0)))).alias("r2"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("me"), F.count(F.lit(1)).alias("n"),
    )
    return with_quantiles(got, preds, keys, F.abs(d), {"medae": 0.5})


def trimmed_r2(preds: DataFrame, keys: list[str], q: float = 0.98, y: str = "y", p: str = "yhat") -> DataFrame:
    """R2 without the rows whose absolute error exceeds its q-quantile."""
    e = F.abs(F.col(p) - F.col(y))
    cut = keyed_quantiles(preds, keys, e, [q]).select(*keys, F.col("q")[0].alias("__cut"))
    kept = preds.join(cut, keys).where(e <= F.col("__cut"))
    return regression_metrics(kept, keys, y, p).select(*keys, F.col("r2").alias("r2_trimmed"), F.col("n").alias("n_kept"))


def cv_summary(preds: DataFrame, scheme: str, fold: str, y: str = "y", p: str = "yhat") -> DataFrame:
    """R2 of each fold and, with a null fold, over all folds of a scheme, from one scan."""
    d = F.col(p) - F.col(y)
    r2 = 1 - F.try_divide(F.sum(d * d), F.nullif(F.regr_syy(F.col(y), F.col(y)), F.lit(0.0)))
    return preds.groupingSets([[scheme, fold], [scheme]], scheme, fold).agg(r2.alias("r2"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def null_r2(df: DataFrame, fold: str = "fold", y: str = "y") -> DataFrame:
    """R2 on each fold of predicting the mean of the other folds."""
    per = df.groupBy(fold).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    total = df.agg(F.count(y).alias("all_n"), F.sum(y).alias("all_s"))
    m = F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"))
    sse = F.col("ss") - 2 * m * F.col("s") + F.col("n") * m * m
    return per.crossJoin(F.broadcast(total)).select(fold, (1 - F.try_divide(sse, F.col("ss") - F.col("s") * F.col("s") / F.col("n"))).alias("r2_null"))  # one row


def seed_summary(runs: DataFrame, keys: list[str], metrics: list[str], ddof: int = 0) -> DataFrame:
    sd = F.stddev_samp if ddof else F.stddev_pop
    return runs.groupBy(*keys).agg(*[f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (sd, "sd"))], F.count(F.lit(1)).alias("n"))


def interval_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "yhat", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Coverage, mean and median width, correlation of the width with the absolute error, and pinball loss at 0.05, 0.5 and 0.95."""
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    w = b - a
    pin = lambda q, v: F.avg(F.greatest(q * (F.col(y) - v), (q - 1) * (F.col(y) - v)))
    got = preds.groupBy(*keys).agg(
        F.avg(F.col(y).between(a, b).cast("double")).alias("coverage"), F.avg(w).alias("mean_width"),
        F.corr(w, F.abs(F.col(p) - F.col(y))).alias("width_error_corr"), pin(0.05, a).alias("pinball_05"), pin(0.5, F.col(p)).alias("pinball_50"), pin(0.95, b).alias("pinball_95"), F.count(F.lit(1)).alias("n"),
    )
    return with_quantiles(got, preds, keys, w, {"median_width": 0.5})


def interval_by_stratum(preds: DataFrame, p: str = "yhat", least: int = 10) -> DataFrame:
    """interval_metrics by quartile of the prediction, the last one closed."""
    a, b, c = ranking.quantiles(preds, p, [0.25, 0.5, 0.75])
    stratum = F.when(F.col(p) < F.lit(a), 0).when(F.col(p) < F.lit(b), 1).when(F.col(p) < F.lit(c), 2).otherwise(3)
    return interval_metrics(preds.withColumn("stratum", stratum), ["stratum"]).where(F.col("n") >= least)


def flag_outliers(preds: DataFrame, q: float = 0.9, y: str = "y", p: str = "yhat") -> DataFrame:
    e = F.abs(F.col(p) - F.col(y))
    cut = ranking.quantiles(preds.select(e.alias("e")), "e", [q])[0]
    return preds.withColumn("outlier", e >= F.lit(cut))


def error_summary(preds: DataFrame, keys: list[str], y: str = "y", p: str = "yhat") -> DataFrame:
    """n, mean, deviation, median and 0.9-quantile of the absolute error, and the mean error in percent of positive observations, of each key."""
    e = error_table(preds, y, p)
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("mae"), F.stddev_samp("absolute_error").alias("sd"), F.avg("percent_error").alias("mean_percent"))
    return with_quantiles(g, e, keys, "absolute_error", {"median": 0.5, "q90": 0.9})


def transfer_drop(runs: DataFrame, source: str, target: str, metric: str = "r2") -> DataFrame:
    """(source, target, metric, drop): the mean metric of each pair of domains, and that less the metric of the target by itself (null without one)."""
    m = runs.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.avg(metric).alias(metric))
    own = m.where("source = target").select("target", F.col(metric).alias("__own"))
    return m.join(own, "target", "left").select("source", "target", metric, (F.col(metric) - F.col("__own")).alias("drop"))


def cv_verdict(runs: DataFrame, scheme: str, reference: str, metric: str = "r2", share: float = 0.5) -> DataFrame:
    """One row (worst, max_drop, holds): the least mean metric of the other schemes, how far it is below the reference scheme's, and whether it keeps more than `share` of that."""
    m = runs.groupBy(F.col(scheme).alias("__s")).agg(F.avg(metric).alias("__m"))
    base = F.max(F.when(F.col("__s") == reference, F.col("__m")))
    worst = F.min(F.when(F.col("__s") != reference, F.col("__m")))
    return m.agg(worst.alias("worst"), base.alias("__b")).select("worst", (F.col("__b") - F.col("worst")).alias("max_drop"), (F.col("worst") > share * F.col("__b")).alias("holds"))


def against_targets(measured: DataFrame, targets: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, measured, target, difference) for every metric of which a row of targets has the same keys."""
    stack = lambda df, out: df.select(*keys, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", out))
    return stack(measured, "measured").join(stack(targets, "target"), [*keys, "metric"]).withColumn("difference", F.col("measured") - F.col("target"))


def separation_summary(rows: DataFrame, scheme: str, fold: str, distance: str) -> DataFrame:
    """(scheme, median_km, n_test): the median over folds of each fold's median distance from test to training places. Folds are few."""
    per = rows.groupBy(scheme, fold).agg(F.count(F.lit(1)).alias("__n"))
    per = with_quantiles(per, rows, [scheme, fold], distance, {"__m": 0.5})
    return per.groupBy(scheme).agg(F.percentile("__m", F.lit(0.5)).alias("median_km"), F.sum("__n").alias("n_test"))


def twin_share(near: DataFrame, keys: list[str], km: float = 0.02, distance: str = "nn_km") -> DataFrame:
    """(keys, twin_share): the share of rows whose nearest training place is closer than km; rows without one count as far."""
    return near.groupBy(*keys).agg(F.avg(F.coalesce(F.col(distance) < km, F.lit(False)).cast("double")).alias("twin_share"))


def drift(vectors: DataFrame, key: str, year: str, vector: str, first: int, last: int) -> DataFrame:
    """One row (n, cosine_mean, cosine_p05, relative_l2_mean): how far the vectors of one year are from those of the same keys in another."""
    from ..functions.arrays import cosine, relative_l2

    a = vectors.where(F.col(year) == first).select(key, F.col(vector).alias("__a"))
    b = vectors.where(F.col(year) == last).select(key, F.col(vector).alias("__b"))
    c = a.join(b, key).select(cosine(F.col("__a"), F.col("__b")).alias("__c"), relative_l2(F.col("__b"), F.col("__a")).alias("__d"))
    return with_quantiles(c.agg(F.count(F.lit(1)).alias("n"), F.avg("__c").alias("cosine_mean"), F.avg("__d").alias("relative_l2_mean")), c, [], "__c", {"cosine_p05": 0.05})


def prediction_stability(preds: DataFrame, key: str, year: str, seed: str, first: int, last: int, p: str = "yhat") -> DataFrame:
    """(seed, n, r, mad): correlation and mean absolute change of the predictions of the same keys in two years, for each seed."""
    a = preds.where(F.col(year) == first).select(key, seed, F.col(p).alias("__a"))
    b = preds.where(F.col(year) == last).select(key, seed, F.col(p).alias("__b"))
    return a.join(b, [key, seed]).groupBy(seed).agg(F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("r"), F.avg(F.abs(F.col("__b") - F.col("__a"))).alias("mad"))


def change_map(pixels: DataFrame, keys: list[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """(keys, diff): the value of one year less that of an earlier one, where both have the pixel."""
    a = pixels.where(F.col(year) == first).select(*keys, F.col(value).alias("__a"))
    b = pixels.where(F.col(year) == last).select(*keys, F.col(value).alias("__b"))
    return a.join(b, keys).select(*keys, (F.col("__b") - F.col("__a")).alias("diff"))


def error_table(preds: DataFrame, y: str = "y", p: str = "yhat") -> DataFrame:
    e = F.abs(F.col(p) - F.col(y))
    return preds.withColumns({"absolute_error": e, "percent_error": F.when(F.col(y) > 0, F.try_divide(100 * e, F.col(y)))})


def group_enrichment(flagged: DataFrame, key: str, least: int = 50, y: str = "y", p: str = "yhat", none: str = "unassigned") -> DataFrame:
    """Rows, error and share of outliers of each group, and that share over the share of all rows."""
    base = flagged.agg(F.avg(F.col("outlier").cast("double")).alias("__base"))
    g = flagged.withColumn(key, F.coalesce(key, F.lit(none))).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.avg(F.col("outlier").cast("double")).alias("outlier_rate"))
    return g.where(F.col("n") >= least).crossJoin(F.broadcast(base)).select(key, "n", "mae", "outlier_rate", F.try_divide("outlier_rate", "__base").alias("enrichment")).orderBy(F.desc("enrichment"), key)  # one row


def decile_profile(flagged: DataFrame, y: str = "y", p: str = "yhat") -> DataFrame:
    """Rows, mean, share of outliers and mean residual by decile of the observation; equal edges are one, bins are closed on the right."""
    edges = sorted({e for e in ranking.quantiles(flagged, y, [i / 10 for i in range(11)]) if e is not None})
    below = sum((F.when(F.col(y) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    b = flagged.withColumn("decile", F.greatest(F.lit(0), below - 1))
    return b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), F.avg(F.col("outlier").cast("double")).alias("outlier_rate"), F.avg(F.col(y) - F.col(p)).alias("mean_residual"))


def variance_table(ratios: DataFrame, k: str = "k", ratio: str = "ratio", targets: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """One row: the first component at which the running sum of ratios reaches each target. Components are few."""
    c = ratios.withColumn("__c", F.sum(ratio).over(Window.orderBy(k).rowsBetween(Window.unboundedPreceding, 0)))
    return c.agg(*[F.min(F.when(F.col("__c") >= t, F.col(k))).alias(f"k_{round(100 * t)}") for t in targets])


def hist_density(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, density) of equal bins from the least to the greatest value, the last one closed."""
    ends = df.agg(F.min(column).alias("__a"), F.max(column).alias("__b"), F.count(column).alias("__n"))
    w = (F.col("__b") - F.col("__a")) / bins
    x = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("__a")) / w)).cast("int")
    return x.groupBy(b.alias("bin"), "__a", "__b", "__n").agg(F.count(F.lit(1)).alias("n")).select("bin", "n", (F.col("n") / (F.col("__n") * w)).alias("density"))


def kde_grid(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(x, density): Gaussian kernel density on a fixed grid, Scott's bandwidth; each task sums its rows at all grid points."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    a, b, n, sd = known.agg(F.min("v"), F.max("v"), F.count("v"), F.stddev_samp("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = (sd or 0.0) * n**-0.2
    grid = a + np.arange(points) * (b - a) / (points - 1)

    def summed(items):
        total = np.zeros(points)
        for batch in items:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 4096):
                with np.errstate(divide="ignore", invalid="ignore"):
                    total += np.exp(-0.5 * ((grid[None, :] - v[at : at + 4096, None]) / h) ** 2).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(points), pa.int32()), "s": pa.array(total)})

    got = known.mapInArrow(summed, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    x = F.lit(float(a)) + F.col("i") * float(b - a) / (points - 1)
    return got.select(x.alias("x"), (F.col("s") / F.lit(n * h * 2.5066282746310002)).alias("density") if h else F.lit(None).cast("double").alias("density"))


def mean_ci(runs: DataFrame, metric: str, config: str = "config", model: str | None = None) -> DataFrame:
    """Mean with a normal 95 % interval; configurations by their best mean."""
    keys = [config] + ([model] if model else [])
    m = runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), (1.96 * F.stddev_pop(metric) / F.sqrt(F.count(metric))).alias("half"), F.count(metric).alias("n"))
    return m.withColumn("best", F.max("mean").over(Window.partitionBy(config))).orderBy(F.desc("best"), *keys)


def importance_summary(imp: DataFrame, run: str = "seed", category: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, shares): the mean importance of features over runs of the commonest width, and each category's share of a run's sum, mean and deviation over runs."""
    widths = imp.groupBy(run).agg(F.count(F.lit(1)).alias("__w"))
    modal = widths.groupBy("__w").agg(F.count(F.lit(1)).alias("__c")).orderBy(F.desc("__c"), F.desc("__w")).limit(1).select("__w")
    kept = imp.join(widths.join(F.broadcast(modal), "__w", "left_semi").select(run), run, "left_semi")  # one row
    features = kept.groupBy("feature").agg(F.avg("importance").alias("importance"))
    if category is None:
        return features, features
    total = Window.partitionBy(run)
    per = kept.withColumn("category", category).groupBy(run, "category").agg(F.sum("importance").alias("x")).withColumn("share", F.try_divide("x", F.sum("x").over(total)))
    return features, per.groupBy("category").agg(F.avg("share").alias("share_mean"), F.stddev_samp("share").alias("share_sd"), F.count(F.lit(1)).alias("n"))


def location_stats(df: DataFrame, decimals: int = 6, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    at = df.groupBy(F.round(lat, decimals).alias("a"), F.round(lon, decimals).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return at.agg(F.count(F.lit(1)).alias("n_locations"), F.sum("n").alias("n_samples"), F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("share_colocated"))
