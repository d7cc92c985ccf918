"""Queries of ranks, folds, tests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.geo import tile_centre
from ..functions.hashing import RANGE, mixed_sql, portable_hash_sql
from ..operators import aggregates as agg
from ..operators import folds, inference, joins, ranking
from .registry import query, rounded
from .relational import FLAGGED, KM, SITES, sites


h = portable_hash_sql
RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2e0"
PHI = "CASE WHEN {z} IS NULL THEN NULL ELSE least(1e0, ((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-{z} * {z} / 2)) END"


@query("W1_avg_rank", "f_preds", sql=f"SELECT sample_k, round({RANK.format(k='config', v='tied_covariate')}, 6) AS r FROM f_preds")
def _(p):
    return rounded(ranking.with_avg_rank(p, "tied_covariate", ["config"], "r").select("sample_k", "r"))


@query("W2_spearman", "f_preds", sql=f"WITH r AS (SELECT config, {RANK.format(k='config', v='y')} AS a, {RANK.format(k='config', v='yhat')} AS b FROM f_preds) SELECT config, round(corr(a, b), 6) AS rho FROM r GROUP BY config")
def _(p):
    return rounded(ranking.spearman(p, "y", "yhat", ["config"]))


@query("W3_bh_fdr", "f_runs", sql="WITH t AS (SELECT config, run_seed, CASE WHEN run_seed = 3 THEN NULL ELSE r2 / 2 END AS p FROM f_runs), a AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY p NULLS LAST) AS u, count(p) OVER (PARTITION BY config) AS n FROM t) SELECT config, run_seed, CASE WHEN p IS NOT NULL THEN round(least(1e0, min(p * n / u) OVER (PARTITION BY config ORDER BY u DESC ROWS UNBOUNDED PRECEDING)), 6) END AS q FROM a")
def _(r):
    t = r.select("config", "run_seed", F.when(F.col("run_seed") != 3, F.col("r2") / 2).alias("p"))
    return rounded(ranking.bh_fdr(t, "p", "config").select("config", "run_seed", "q"))


@query("W5_cumulative", "f_importance", sql="SELECT seed, feature, round(sum(importance) OVER (PARTITION BY seed ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS c FROM f_importance")
def _(i):
    from pyspark.sql import Window

    return rounded(i.select("seed", "feature", F.sum("importance").over(Window.partitionBy("seed").orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)).alias("c")))


@query("W7_global_rank", "f_preds", sql="SELECT sample_k, rank() OVER (ORDER BY tied_covariate) + (count(*) OVER (PARTITION BY tied_covariate) - 1) / 2e0 AS rank FROM f_preds")
def _(p):
    return ranking.global_rank(p.select("sample_k", "tied_covariate"), "tied_covariate").select("sample_k", "rank")


@query("T1_top_features", "f_importance", sql="SELECT feature, round(avg(importance), 6) AS importance FROM f_importance WHERE seed <= 4 GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 30")
def _(i):
    return rounded(ranking.top(agg.importance_summary(i)[0], [F.desc(F.round("importance", 9)), F.asc("feature")], 30))


PAIRS = "WITH c AS (SELECT 'y' AS x, 'lo' AS y, corr(y, lo) AS r FROM f_preds UNION ALL SELECT 'y', 'hi', corr(y, hi) FROM f_preds UNION ALL SELECT 'yhat', 'lo', corr(yhat, lo) FROM f_preds UNION ALL SELECT 'yhat', 'hi', corr(yhat, hi) FROM f_preds) SELECT x, y, round(r, 6) AS r FROM c"


@query("I9_cross_corr", "f_preds", sql=PAIRS)
def _(p):
    return rounded(inference.cross_corr(p, ["y", "yhat"], ["lo", "hi"]))


@query("T2_top_pairs", "f_preds", sql=PAIRS + " ORDER BY abs(r) DESC, x, y LIMIT 2")
def _(p):
    c = rounded(inference.cross_corr(p, ["y", "yhat"], ["lo", "hi"]))
    return ranking.top(c, [F.desc(F.abs("r")), F.asc("x"), F.asc("y")], 2)


@query("T3_worst_errors", "f_preds", sql="SELECT sample_k, round(abs(yhat - y), 6) AS absolute_error FROM f_preds ORDER BY 2 DESC, 1")
def _(p):
    return p.select("sample_k", F.round(F.abs(F.col("yhat") - F.col("y")), 6).alias("absolute_error")).orderBy(F.desc("absolute_error"), "sample_k")


@query("T4_representative_run", "f_runs", sql="WITH m AS (SELECT config, run_seed, abs(r2 - avg(r2) OVER (PARTITION BY config)) AS d FROM f_runs), r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(d, 12), run_seed) AS n FROM m) SELECT config, run_seed FROM r WHERE n = 1")
def _(r):
    return ranking.representative_run(r, ["config"])


@query("T5_best_by", "f_runs", sql="SELECT run_seed, max_by(config, r2) AS config, round(max(r2), 6) AS r2 FROM f_runs GROUP BY run_seed")
def _(r):
    return rounded(ranking.best_by(r, ["run_seed"], "r2", "config"))


@query("T6_capture_curve", "f_preds", sql="WITH r AS (SELECT abs(yhat - y) AS e, row_number() OVER (ORDER BY yhat DESC) AS n FROM f_preds), f AS (SELECT unnest([0.05e0, 0.1e0, 0.2e0]) AS fraction), m AS (SELECT fraction, greatest(1, CAST(round_even(fraction * (SELECT count(*) FROM r), 0) AS BIGINT)) AS m FROM f) SELECT fraction, m, round(sum(e) FILTER (WHERE n <= m) / sum(e), 6) AS share, round(sum(e) FILTER (WHERE n <= m) / sum(e) / fraction, 6) AS lift FROM m, r GROUP BY fraction, m")
def _(p):
    return rounded(ranking.capture_curve(p.withColumn("e", F.col("yhat") - F.col("y")), "yhat", "e"))


@query("A25_prediction_stability", "f_preds", sql="WITH b AS (SELECT seed, sample_k, yhat AS a, lo AS c FROM f_preds) SELECT seed, count(*) AS n, round(corr(a, c), 6) AS r, round(avg(abs(a - c)), 6) AS mad FROM b GROUP BY seed")
def _(p):
    years = p.select("seed", "sample_k", F.lit(2017).alias("year"), "yhat").union(p.select("seed", "sample_k", F.lit(2024), "lo"))
    return rounded(agg.prediction_stability(years, "sample_k", "year", "seed", 2017, 2024))


@query("A27_twin_share", "f_samples", sql=f"WITH t AS ({SITES}), n AS (SELECT a.id, min({KM}) AS km FROM t a, t b WHERE a.id % 4 = 0 AND b.id % 4 = 1 GROUP BY a.id) SELECT round(avg(CASE WHEN km < 0.02 THEN 1e0 ELSE 0e0 END), 6) AS twin_share FROM n")
def _(s):
    t = sites(s)
    return rounded(agg.twin_share(joins.nn_distance(t.where("id % 4 = 0"), t.where("id % 4 = 1")), []))


@query("A33_transfer_drop", "f_runs", sql="WITH m AS (SELECT substr(config, 1, 1) AS source, CASE substr(config, 3, 1) WHEN 'F' THEN 'A' ELSE 'N' END AS target, avg(r2) AS r2 FROM f_runs GROUP BY config) SELECT a.source, a.target, round(a.r2, 6) AS r2, round(a.r2 - b.r2, 6) + 0e0 AS \"drop\" FROM m a LEFT JOIN m b ON a.target = b.target AND b.source = b.target")
def _(r):
    domains = r.select("r2", F.substring("config", 1, 1).alias("s"), F.when(F.substring("config", 3, 1) == "F", "A").otherwise("N").alias("t"))
    return rounded(agg.transfer_drop(domains, "s", "t"))


@query("A34_cv_verdict", "f_runs", sql="WITH m AS (SELECT config, avg(r2) AS r2 FROM f_runs GROUP BY config), b AS (SELECT r2 AS base FROM m WHERE config = 'A_F') SELECT round(min(r2), 6) AS worst, round(max(base - r2), 6) AS max_drop, min(r2) > 0.5 * max(base) AS holds FROM m, b WHERE config <> 'A_F'")
def _(r):
    return rounded(agg.cv_verdict(r, "config", "A_F"))


@query("A38_compare_targets", "f_runs", sql="WITH t(config, metric, target) AS (VALUES ('A_F', 'r2', 0.512e0), ('A_F', 'mae', 29.2e0), ('N_O', 'r2', 0.535e0), ('N_O', 'mae', 29.07e0)), m AS (SELECT config, avg(r2) AS r2, avg(mae) AS mae FROM f_runs GROUP BY config), l AS (SELECT config, 'r2' AS metric, r2 AS measured FROM m UNION ALL SELECT config, 'mae', mae FROM m) SELECT config, metric, round(measured, 6) AS measured, target, round(measured - target, 6) + 0e0 AS difference FROM l JOIN t USING (config, metric)")
def _(r):
    targets = r.sparkSession.createDataFrame([("A_F", 0.512, 29.2), ("N_O", 0.535, 29.07)], "config string, r2 double, mae double")
    return rounded(agg.against_targets(r.groupBy("config").agg(F.avg("r2").alias("r2"), F.avg("mae").alias("mae")), targets, ["config"], ["r2", "mae"]))


@query("A39_separation_summary", "f_preds", sql="WITH f AS (SELECT config, fold, quantile_cont(hi - lo, 0.5) AS m, count(*) AS n FROM f_preds GROUP BY config, fold) SELECT config, round(quantile_cont(m, 0.5), 6) AS median_km, sum(n) AS n_test FROM f GROUP BY config")
def _(p):
    return rounded(agg.separation_summary(p.withColumn("km", F.col("hi") - F.col("lo")), "config", "fold", "km"))


@query("A30_error_summary", "f_preds", sql="SELECT config, count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(stddev_samp(abs(yhat - y)), 6) AS sd, round(avg(CASE WHEN y > 0 THEN 100 * abs(yhat - y) / y END), 6) AS mean_percent, round(quantile_cont(abs(yhat - y), 0.5), 6) AS median, round(quantile_cont(abs(yhat - y), 0.9), 6) AS q90 FROM f_preds GROUP BY config")
def _(p):
    return rounded(agg.error_summary(p, ["config"]))


@query("F2_tile_of", "f_samples", sql="SELECT sample_id, round(floor(longitude * 10) / 10e0 + 0.05e0, 2) AS x, round(floor(latitude * 10) / 10e0 + 0.05e0, 2) AS y FROM f_samples")
def _(s):
    return s.select("sample_id", tile_centre(F.col("longitude")).alias("x"), tile_centre(F.col("latitude")).alias("y"))


@query("F11_flatten_patch", "f_patch", sql="SELECT sample_id, vec[1] AS patch_0, vec[64] AS patch_63 FROM f_patch")
def _(p):
    return p.select("sample_id", F.col("vec")[0].alias("patch_0"), F.col("vec")[63].alias("patch_63"))


@query("F17_distributions", "f_runs", sql="WITH z AS (SELECT config, run_seed, r2 * 3 - 1.5e0 AS z FROM f_runs), t AS (SELECT *, 1 / (1 + 0.3275911e0 * abs(z) / 1.4142135623730951e0) AS t FROM z) SELECT config, run_seed, round(least(1e0, ((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-z * z / 2)), 6) AS p FROM t")
def _(r):
    return rounded(r.select("config", "run_seed", stats.p_two_sided(F.col("r2") * 3 - 1.5).alias("p")))


@query("V1_random_folds", "f_samples", sql=f"SELECT sample_id, CAST({h('k', 7)} % 5 AS INT) AS fold FROM f_samples")
def _(s):
    return folds.random_folds(s, 5, 7).select("sample_id", "fold")


@query("V3_distance_groups", "f_samples", sql=f"WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY la, lo) AS id, la AS lat, lo AS lon, ids FROM (SELECT round(latitude, 7) AS la, round(longitude, 7) AS lo, list(k) AS ids FROM f_samples GROUP BY 1, 2)), e AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON abs(a.lat - b.lat) < 0.001 AND abs(a.lon - b.lon) < 0.002 AND {KM} <= 0.025), r AS (SELECT id AS x, id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x), m AS (SELECT unnest(t.ids) AS k, c.c FROM t JOIN c ON t.id = c.x) SELECT k, min(k) OVER (PARTITION BY c) AS leader FROM m")
def _(s):
    from pyspark.sql import Window

    return folds.distance_groups(s, 25.0).select("k", F.min("k").over(Window.partitionBy("group")).alias("leader"))


def lpt(sizes: str, group: str, k: int, seed: int) -> str:
    """Common table expressions that end in dealt (group, fold), of sizes (group, n): largest first, each to the least loaded fold."""
    zeros, js = ", ".join(["0"] * k), ", ".join(map(str, range(1, k + 1)))
    return (
        f"lr AS (SELECT {group}, n, row_number() OVER (ORDER BY n DESC, {h(group, seed)}, {group}) AS i FROM {sizes}), "
        f"ls AS (SELECT CAST(0 AS BIGINT) AS i, CAST([{zeros}] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS {group}, CAST(NULL AS INT) AS fold UNION ALL "
        f"SELECT r.i, list_transform([{js}], lambda j: CASE WHEN j = s.f THEN s.loads[j] + r.n ELSE s.loads[j] END), r.{group}, CAST(s.f - 1 AS INT) "
        f"FROM (SELECT *, list_position(loads, list_min(loads)) AS f FROM ls) s JOIN lr r ON r.i = s.i + 1), dealt AS (SELECT {group}, fold FROM ls WHERE i > 0)"
    )


@query("V5_pack_groups", "f_samples", sql=f"WITH RECURSIVE g AS (SELECT site, count(*) AS n FROM f_samples GROUP BY site), {lpt('g', 'site', 5, 3)} SELECT site, fold FROM dealt")
def _(s):
    return folds.pack_groups(s.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "site", 5, 3)


PLACE = "CAST(round((round(latitude, 6) + 90) * 1000000) AS BIGINT) * 4294967296 + CAST(round((round(longitude, 6) + 180) * 1000000) AS BIGINT)"


@query("V2_location_folds", "f_samples", sql=f"WITH RECURSIVE p AS (SELECT k, {PLACE} AS place FROM f_samples), g AS (SELECT place, count(*) AS n FROM p GROUP BY place), {lpt('g', 'place', 5, 7)} SELECT k, fold FROM p JOIN dealt USING (place)")
def _(s):
    return folds.location_folds(s, 5, 7).select("k", "fold")


BLOCK = "CAST(floor(radians(longitude) * 6371008.8e0 * cos(radians(latitude)) / 50e0) + 1073741824 AS BIGINT) * 2147483648 + CAST(floor(radians(latitude) * 6371008.8e0 / 50e0) + 1073741824 AS BIGINT)"


@query("V4_block_folds", "f_samples", sql=f"WITH RECURSIVE p AS (SELECT k, {BLOCK} AS block FROM f_samples), g AS (SELECT block, count(*) AS n FROM p GROUP BY block), {lpt('g', 'block', 5, 7)} SELECT k, fold FROM p JOIN dealt USING (block)")
def _(s):
    return folds.block_folds(s, 50.0, 5, 7).select("k", "fold")


@query("V6_split3", "f_samples", sql=f"SELECT sample_id, CASE WHEN {h('k', 4)} / 4294967296e0 < 0.2 THEN 'test' WHEN {h('k', 4)} / 4294967296e0 < 0.3 THEN 'validation' ELSE 'train' END AS split FROM f_samples")
def _(s):
    return folds.split3(s, 4).select("sample_id", "split")


WITHIN = f"WITH r AS (SELECT sample_id, continent, row_number() OVER (PARTITION BY continent ORDER BY {h('k', 5)}, k) AS r, count(*) OVER (PARTITION BY continent) AS n FROM f_samples)"


@query("V7_split_within", "f_samples", sql=WITHIN + " SELECT sample_id, CASE WHEN r <= round(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r")
def _(s):
    return folds.split_within(s, "continent", 5).select("sample_id", "split")


@query("V8_stratified_sample", "f_samples", sql=WITHIN + " SELECT sample_id FROM r WHERE r <= round(0.05 * n)")
def _(s):
    return folds.stratified_sample(s, "continent", 0.05, 5).select("sample_id")


@query("V9_sample_manifest", "f_samples", "f_patch", "f_landcover", sql=WITHIN + ", i AS (SELECT sample_id FROM r WHERE r <= round(0.05 * n)) SELECT 'patch' AS \"table\", count(*) AS kept FROM f_patch WHERE sample_id IN (SELECT sample_id FROM i) UNION ALL SELECT 'landcover', count(*) FROM f_landcover WHERE sample_id IN (SELECT sample_id FROM i)")
def _(s, p, lc):
    return folds.sample_manifest({"patch": p, "landcover": lc}, folds.stratified_sample(s, "continent", 0.05, 5))


@query("J19_apply_buffer", "f_samples", sql=f"WITH t AS ({SITES}), a AS (SELECT * FROM t WHERE id % 5 <> 0), b AS (SELECT * FROM t WHERE id % 5 = 0) SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {KM} <= 5) AND (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {KM} <= 5)) >= 10")
def _(s):
    return folds.apply_buffer(sites(s).withColumn("fold", (F.col("id") % 5).cast("int")), 0, 5.0).select("id")


RUN_PAIRS = "p AS (SELECT o.config, o.r2 AS own, r.r2 AS ref FROM f_runs o JOIN f_runs r USING (run_seed) WHERE o.config <> 'A_F' AND r.config = 'A_F')"
# Seven seeds give six degrees of freedom, for which tables have 2.4469.
TC = "2.4468043919795262e0"


@query("I1_paired_compare", "f_runs", sql=f"WITH {RUN_PAIRS}, g AS (SELECT config, avg(own - ref) AS m, stddev_samp(own - ref) AS s, count(*) AS n, count(*) FILTER (WHERE own > ref) AS wins FROM p GROUP BY config) SELECT config, round(m, 6) + 0e0 AS mean_diff, round(s, 6) AS sd_diff, n, wins, round(m - {TC} * s / sqrt(n), 4) + 0e0 AS lo, round(m + {TC} * s / sqrt(n), 4) + 0e0 AS hi, round(wins / n, 6) AS win_rate, CASE WHEN m > 0 THEN 'better' WHEN m < 0 THEN 'worse' ELSE 'equal' END AS direction FROM g")
def _(r):
    out = inference.paired_compare(joins.pair_runs(r, "A_F", [], "r2"), ["config"])
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("lo", "hi")}))


@query("I2_wilcoxon", "f_runs", sql=f"WITH {RUN_PAIRS}, d AS (SELECT config, round(own - ref, 12) AS d FROM p WHERE round(own - ref, 12) <> 0), r AS (SELECT config, d, {RANK.format(k='config', v='abs(d)')} AS r, count(*) OVER (PARTITION BY config, abs(d)) AS t FROM d), g AS (SELECT config, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS w, count(*) AS n, sum(t * t - 1e0) AS tie FROM r GROUP BY config), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM g), t AS (SELECT *, 1 / (1 + 0.3275911e0 * abs(z) / 1.4142135623730951e0) AS t FROM z) SELECT config, round(w, 6) AS w_plus, n, round({PHI.format(z='z')}, 6) AS p FROM t")
def _(r):
    return rounded(inference.wilcoxon(joins.pair_runs(r, "A_F", [], "r2"), ["config"]))


@query("I3_mann_whitney", "f_preds", sql=f"WITH {FLAGGED}, r AS (SELECT config, outlier, {RANK.format(k='config', v='tied_covariate')} AS r, count(*) OVER (PARTITION BY config, tied_covariate) AS t FROM o), g AS (SELECT config, count(*) FILTER (WHERE outlier) AS a, count(*) FILTER (WHERE NOT outlier) AS b, sum(r) FILTER (WHERE outlier) AS r1, sum(t * t - 1e0) AS tie FROM r GROUP BY config), z AS (SELECT *, (r1 - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1e0)))) AS z FROM g), t AS (SELECT *, 1 / (1 + 0.3275911e0 * abs(z) / 1.4142135623730951e0) AS t FROM z) SELECT config, a AS n_true, b AS n_false, round(r1 - a * (a + 1) / 2, 6) AS u, round({PHI.format(z='z')}, 6) AS p FROM t")
def _(p):
    return rounded(inference.mann_whitney(agg.flag_outliers(p), ["config"], "tied_covariate", "outlier"))


@query("I4_cohens_d", "f_preds", sql=f"WITH {FLAGGED} SELECT config, round((avg(tied_covariate) FILTER (WHERE outlier) - avg(tied_covariate) FILTER (WHERE NOT outlier)) / sqrt(((count(*) FILTER (WHERE outlier)) * var_pop(tied_covariate) FILTER (WHERE outlier) + (count(*) FILTER (WHERE NOT outlier)) * var_pop(tied_covariate) FILTER (WHERE NOT outlier)) / (count(*) - 2)), 6) + 0e0 AS d FROM o GROUP BY config")
def _(p):
    return rounded(inference.cohens_d(agg.flag_outliers(p), ["config"], "tied_covariate", "outlier"))


CUTS = inference.CUTS
WEIGHT = "CASE " + " ".join(f"WHEN u < {c * RANGE!r} THEN {i}" for i, c in enumerate(CUTS)) + f" ELSE {len(CUTS)} END"


def drawn(source: str, key: str, replicates: int, seed: int) -> str:
    """A subquery of source with rep and w, the Poisson weights of inference.boot_weights()."""
    keyed = f"SELECT *, {h(key, seed)} AS hk FROM {source}"
    reps = f"SELECT rep, {mixed_sql('rep')} AS hr FROM range(1, {replicates + 1}) t(rep)"
    return f"(SELECT *, {WEIGHT} AS w FROM (SELECT *, {mixed_sql('xor(hk, hr)')} AS u FROM ({keyed}), ({reps})))"


def d_of(weight: str) -> str:
    """Cohen's d of value between the rows of a group and the others, each counted weight times."""
    n, x, xx = (lambda c, v=v: f"sum(CASE WHEN {c} THEN {weight} * {v} ELSE 0e0 END)" for v in ("1e0", "value", "value * value"))
    a, b = '"group"', 'NOT "group"'
    ss = f"({xx(a)} - {x(a)} * {x(a)} / {n(a)} + {xx(b)} - {x(b)} * {x(b)} / {n(b)})"
    return f"({x(a)} / {n(a)} - {x(b)} / {n(b)}) / sqrt({ss} / ({n(a)} + {n(b)} - 2))"


def d_boot(source: str, key: str, replicates: int, seed: int) -> str:
    """Common table expressions that end in db (key, d, lo, hi), of source (key, sample_k, value, group)."""
    return (
        f"dr AS (SELECT {key}, rep, {d_of('w')} AS d FROM {drawn(source, 'sample_k', replicates, seed)} GROUP BY {key}, rep), "
        f"dq AS (SELECT {key}, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM dr GROUP BY {key}), "
        f"dd AS (SELECT {key}, {d_of('1e0')} AS d FROM {source} GROUP BY {key}), db AS (SELECT {key}, d, lo, hi FROM dd JOIN dq USING ({key}))"
    )


@query("I4_cohens_d_boot", "f_preds", sql=f"WITH {FLAGGED}, l AS (SELECT config, sample_k, tied_covariate AS value, outlier AS \"group\" FROM o), {d_boot('l', 'config', 1000, 9)} SELECT config, round(d, 6) + 0e0 AS d, round(lo, 6) + 0e0 AS lo, round(hi, 6) + 0e0 AS hi FROM db")
def _(p):
    long = agg.flag_outliers(p).withColumnsRenamed({"tied_covariate": "value", "outlier": "group"})
    return rounded(inference.cohens_d_boot(long, ["config"], "sample_k", 1000, 9))


CONTRASTS = f"""WITH {FLAGGED},
l AS (SELECT sample_k, outlier AS "group", abs(yhat - y) AS error, unnest(['tied_covariate', 'lo', 'hi']) AS variable, unnest([tied_covariate, lo, hi]) AS value FROM o),
{d_boot('l', 'variable', 1000, 9)},
k AS (SELECT variable, "group" AS g, {RANK.format(k='variable', v='value')} AS rv, {RANK.format(k='variable', v='error')} AS re, count(*) OVER (PARTITION BY variable, value) AS t FROM l),
m AS (SELECT variable, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n0, sum(rv) FILTER (WHERE g) AS r1, sum(t * t - 1e0) AS tie, corr(rv, re) AS rho FROM k GROUP BY variable),
z AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1e0)))) AS z FROM m),
tt AS (SELECT *, 1 / (1 + 0.3275911e0 * abs(z) / 1.4142135623730951e0) AS t FROM z),
pp AS (SELECT *, {PHI.format(z='z')} AS p FROM tt),
qq AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pp)
SELECT variable, round(d, 6) + 0e0 AS d, round(lo, 6) + 0e0 AS lo, round(hi, 6) + 0e0 AS hi, n1 AS n_true, n0 AS n_false, round(u, 6) AS u, round(p, 6) AS p, round(rho, 6) + 0e0 AS rho,
       round(least(1e0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS q
FROM qq JOIN db USING (variable)"""


@query("I5_contrasts", "f_preds", sql=CONTRASTS)
def _(p):
    o = agg.flag_outliers(p)
    long = o.unpivot(["sample_k", "outlier", F.abs(F.col("yhat") - F.col("y")).alias("error")], ["tied_covariate", "lo", "hi"], "variable", "value").withColumnRenamed("outlier", "group")
    d = inference.cohens_d_boot(long, ["variable"], "sample_k", 1000, 9)
    out = d.join(inference.mann_whitney(long, ["variable"]), "variable").join(ranking.spearman(long, "value", "error", ["variable"]), "variable")
    return rounded(ranking.bh_fdr(out, "p")).orderBy(F.desc_nulls_last(F.abs("d")))


@query("I7_boot_weights", "f_preds", sql=f"SELECT rep, sum(w) AS n, count(*) AS n_rows FROM {drawn('f_preds', 'sample_k', 2000, 9)} WHERE w > 0 GROUP BY rep")
def _(p):
    got = inference.boot_sums(p.select("sample_k"), [], "sample_k", {}, 2000, 9, rows_drawn="n_rows")
    return got.select(*[F.col(c).cast("long").alias(c) for c in ("rep", "n", "n_rows")])


@query("I6_corr_boot", "f_preds", sql=f"WITH m AS (SELECT config, rep, sum(w) * 1e0 AS n, sum(w * y) AS sx, sum(w * yhat) AS sy, sum(w * y * y) AS xx, sum(w * yhat * yhat) AS yy, sum(w * y * yhat) AS xy FROM {drawn('(SELECT sample_k, config, y, yhat FROM f_preds)', 'sample_k', 2000, 9)} GROUP BY config, rep), r AS (SELECT config, (xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) AS r FROM m), q AS (SELECT config, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM r GROUP BY config) SELECT f.config, round(corr(f.y, f.yhat), 5) AS r, round(any_value(q.lo), 5) AS lo, round(any_value(q.hi), 5) AS hi FROM f_preds f JOIN q USING (config) GROUP BY f.config")
def _(p):
    return rounded(inference.corr_boot(p, ["config"], "y", "yhat", "sample_k", 2000, 9), 5)


@query("I8_paired_boot_mae", "f_preds", sql=f"WITH e AS (SELECT sample_k, abs(yhat - y) - abs(lo - y) AS d FROM f_preds), r AS (SELECT rep, sum(w * d) / sum(w) AS m FROM {drawn('e', 'sample_k', 2000, 9)} GROUP BY rep), q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM r) SELECT round(avg(d), 6) AS diff, count(*) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, CASE WHEN any_value(hi) < 0 THEN 'a better' WHEN any_value(lo) > 0 THEN 'b better' ELSE 'no difference' END AS verdict FROM e, q")
def _(p):
    a = p.select("sample_k", (F.col("yhat") - F.col("y")).alias("e"))
    return rounded(inference.paired_boot_mae(a, p.select("sample_k", (F.col("lo") - F.col("y")).alias("e")), "sample_k", "e", 2000, 9))


@query("M11_oof_mean", "f_preds", sql="SELECT biome_name, fold, round(avg(yhat), 6) AS yhat FROM f_preds GROUP BY biome_name, fold")
def _(p):
    from ..operators.learn import oof_mean

    return rounded(oof_mean(p, ["biome_name", "fold"]))


Q1_SQL = f"""WITH RECURSIVE st AS (SELECT biome_name, quantile_cont(rarefied, 0.25) AS q1, quantile_cont(rarefied, 0.5) AS q2, quantile_cont(rarefied, 0.75) AS q3 FROM f_samples GROUP BY biome_name),
kept AS (SELECT f.*, CAST(round((round(latitude, 6) + 90) * 1000000) AS BIGINT) * 4294967296 + CAST(round((round(longitude, 6) + 180) * 1000000) AS BIGINT) AS place
         FROM f_samples f JOIN st USING (biome_name) WHERE NOT rarefied > q2 + 5 * (q3 - q1)),
g AS (SELECT place, count(*) AS n FROM kept GROUP BY place), {lpt('g', 'place', 5, 42)},
f AS (SELECT kept.*, dealt.fold FROM kept JOIN dealt USING (place)),
m AS (SELECT fold, ((SELECT sum(rarefied) FROM f) - sum(rarefied)) / ((SELECT count(*) FROM f) - count(*)) AS yhat FROM f GROUP BY fold),
p AS (SELECT biome_name, abs(m.yhat - rarefied) AS e FROM f JOIN m USING (fold)),
c AS (SELECT quantile_cont(e, 0.9) AS cut FROM p),
b AS (SELECT avg(CASE WHEN e >= cut THEN 1e0 ELSE 0e0 END) AS base FROM p, c)
SELECT biome_name, count(*) AS n, round(avg(e), 6) AS mae, round(avg(CASE WHEN e >= cut THEN 1e0 ELSE 0e0 END), 6) AS outlier_rate, round(avg(CASE WHEN e >= cut THEN 1e0 ELSE 0e0 END) / any_value(base), 6) AS enrichment
FROM p, c, b GROUP BY biome_name HAVING count(*) >= 10"""


@query("Q1_error_outliers_by_biome", "f_samples", sql=Q1_SQL)
def _(s):
    kept = agg.iqr_filter(s, "biome_name", "rarefied")[0]
    f = folds.location_folds(kept, 5, 42)
    means = f.groupBy("fold").agg(F.sum("rarefied").alias("s"), F.count("rarefied").alias("n"))
    total = f.agg(F.sum("rarefied").alias("ts"), F.count("rarefied").alias("tn"))
    m = means.crossJoin(total).select("fold", F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("yhat"))  # a row for each fold
    preds = f.join(F.broadcast(m), "fold").withColumnRenamed("rarefied", "y")
    return rounded(agg.group_enrichment(agg.flag_outliers(preds), "biome_name", least=10))
