"""Operators at their edges: independence of draws, exact ranks and quantiles, balance, ties and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.functions import arrays, stats, text
from siteweave.functions.hashing import RANGE, portable_hash
from siteweave.operators import aggregates, folds, inference, joins, ranking
from siteweave.sources import files


def test_replicates_and_seeds_are_independent(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    w = np.zeros((400, 60))
    for r in inference.boot_weights(df, "k", 60, 3).collect():
        w[r["k"], r["rep"] - 1] = r["w"]
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05
    assert np.abs(np.corrcoef(w.T) - np.eye(60)).max() < 0.25
    assert np.abs(np.corrcoef(w) - np.eye(400)).max() < 0.75
    h = np.array([[r[f"h{s}"] for s in range(6)] for r in df.select(*[(portable_hash(F.col("k"), s) / RANGE).alias(f"h{s}") for s in range(6)]).collect()])
    assert np.abs(np.corrcoef(h.T) - np.eye(6)).max() < 0.2
    # No seed's order is another's, rotated.
    steps = {tuple(np.diff(np.argsort(np.argsort(h[:, s]))) % 400) for s in range(6)}
    assert len(steps) == 6


def test_sums_of_replicates_equal_their_rows(spark):
    rows = [(i, "a" if i % 3 else None, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g string, x double").repartition(3)
    got = {(r["g"], r["rep"]): (r["n"], r["s"]) for r in inference.boot_sums(df, ["g"], "k", {"s": F.col("x")}, 20, 5).collect()}
    want = {(r["g"], r["rep"]): (r["n"], r["s"]) for r in inference.boot_weights(df, "k", 20, 5).groupBy("g", "rep").agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s")).collect()}
    assert len(got) == 40 and all(np.allclose(got[k], want[k]) for k in want)


def test_correlation_interval_covers_the_value(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(x, rng.normal(size=500)))], "k long, x double, y double")
    r = inference.corr_boot(df.withColumn("g", F.lit(1)), ["g"], "x", "y", "k", 500, 1).first()
    assert r["lo"] < r["r"] < r["hi"] and 0.05 < r["hi"] - r["lo"] < 0.15


def test_t_points(spark):
    want = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 6: 2.4469, 10: 2.2281, 30: 2.0423}
    got = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in want], "n int").select("n", stats.t_crit(F.col("n")).alias("t")).collect()}
    assert all(abs(got[n] - t) < 0.005 for n, t in want.items())


def test_quantiles_and_ranks_are_exact(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=500).round(2), np.zeros(300), [5.0]])
    rows = [(i, "ab"[i % 2], float(x)) for i, x in enumerate(v)] + [(9000, "a", None), (9001, None, 1.0), (9002, None, 1.0)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    assert np.allclose(ranking.quantiles(df.where("g is not null"), "v", qs), np.quantile(v, qs))
    assert ranking.quantiles(df.limit(0), "v", [0.5]) == [None]
    got = {r["i"]: r["r"] for r in ranking.with_avg_rank(df, "v", ["g"], "r").collect()}
    for g in "ab":
        own = [(i, x) for i, k, x in rows if k == g and x is not None]
        for i, x in own:
            assert got[i] == sum(y < x for _, y in own) + (sum(y == x for _, y in own) + 1) / 2
    assert got[9000] is None and got[9001] == got[9002] == 1.5


SIZES = {
    "all small": {i: 1 + i % 5 for i in range(700)},
    "some large": {0: 4000, 1: 900, **{i: 1 + i % 5 for i in range(2, 700)}},
    "all equal": dict.fromkeys(range(501), 7),
    "few": {3: 2, 8: 9},
    "hot size": {i: 1 if i % 50 else i + 1 for i in range(2000)},
}


@pytest.mark.parametrize("sizes", SIZES.values(), ids=SIZES)
def test_groups_fill_folds_as_one_by_one(spark, sizes):
    k = 4
    df = spark.createDataFrame(list(sizes.items()), "g long, n long").repartition(3)
    got = {r["g"]: r["fold"] for r in folds.pack_groups(df, "g", k, 3).collect()}
    hashes = {r["g"]: r["h"] for r in df.select("g", portable_hash(F.col("g"), 3).alias("h")).collect()}
    loads, want = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashes[g], g)):
        f = loads.index(min(loads))
        want[g] = f
        loads[f] += sizes[g]
    assert got == want
    # No fold that the largest group is not in has more than the least loaded one and the largest of its own.
    for f in range(k):
        own = [sizes[g] for g in got if got[g] == f]
        assert not own or sum(own) - min(own) <= min(loads)
    if len(sizes) > 100:
        other = {r["g"]: r["fold"] for r in folds.pack_groups(df, "g", k, 4).collect()}
        assert sum(other[g] == got[g] for g in got) < 0.6 * len(got)


def test_dealing_equal_groups_equals_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(500):
        loads, size, count = [int(x) for x in rng.integers(0, 50, rng.integers(1, 7))], int(rng.integers(1, 13)), int(rng.integers(1, 60))
        starts, orders, after = folds.deal_equal(loads, size, count)
        for t in range(count):
            f = loads.index(min(loads))
            i = sum(x <= t for x in starts) - 1
            assert orders[i][(t - starts[i]) % len(orders[i])] == f
            loads[f] += size
        assert loads == after and len(starts) <= len(loads)


def test_folds_without_a_training_side_are_left_out(spark):
    one = spark.createDataFrame([(i, 1) for i in range(9)], "k long, g long")
    assert folds.group_folds(one, "g", 5, 1).count() == 0
    two = one.withColumn("g", F.col("k") % 2)
    got = folds.group_folds(two, "g", 5, 1)
    assert got.count() == 9 and got.select("g", "fold").distinct().count() == 2
    assert folds.group_folds(one.limit(0), "g", 5, 1).count() == 0


def test_first_polygon_keeps_identical_points(spark):
    vertices = spark.createDataFrame([(p, "n", i, x, y) for p, (a, b) in ((2, (0.0, 4.0)), (1, (2.0, 6.0))) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])], "poly_id int, name string, vi int, x double, y double")
    polys = joins.polygons(vertices, "poly_id", ["name"])
    points = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0), (1.0, 1.0), (9.0, 9.0), (None, 1.0)], "longitude double, latitude double")
    got = sorted([(r["longitude"], r["poly_id"]) for r in joins.pip_join(points, polys, first_only=True).collect()], key=str)
    assert got == sorted([(3.0, 1), (3.0, 1), (1.0, 2), (9.0, None), (None, None)], key=str)


def test_kde_equals_numpy(spark):
    v = np.random.default_rng(4).normal(size=300)
    got = np.array(sorted((r["x"], r["density"]) for r in aggregates.kde_grid(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 50).collect()))
    h = v.std(ddof=1) * 300**-0.2
    want = np.exp(-0.5 * ((got[:, :1] - v) / h) ** 2).sum(1) / (300 * h * np.sqrt(2 * np.pi))
    assert np.allclose(got[:, 1], want)


def test_values_of_small_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 10.0], "umap_3")], "a array<double>, b array<double>, f string")
    r = df.select(arrays.relative_l2(F.col("a"), F.col("b")).alias("d"), text.block_of(F.col("f")).alias("block")).first()
    assert abs(r["d"] - np.sqrt(45) / 10) < 1e-6 and r["block"] == "Satellite (SSL)"


def test_caches_and_exports(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"sample_id": "1", "v": 2.0}\n{"sample_id": "1", "v": 1.0}\n')
    (tmp_path / "c" / "b.json").write_text('{"sample_id": "1", "v": 0.5}\n{"sample_id": "2"}\n')
    got = {r["sample_id"]: r["v"] for r in files.ingest_feature_cache(spark, str(tmp_path / "c"), "sample_id string, v double").collect()}
    assert got == {"1": 1.0, "2": None}
    df = spark.range(10).repartition(3)
    for kind, n in (("csv", None), ("json", 1)):
        files.export(df, str(tmp_path / kind), kind, n)
        assert len(list((tmp_path / kind).glob("part-*"))) == (n or 3)
        read = spark.read.option("header", True).csv(str(tmp_path / kind)) if kind == "csv" else spark.read.json(str(tmp_path / kind))
        assert sorted(int(r["id"]) for r in read.collect()) == list(range(10))


def test_draws_equal_the_hash_in_sql_terms_and_keys_in_several_groups(spark):
    from siteweave.functions.hashing import RANGE, draw_hashes
    from siteweave.operators import inference

    cuts = np.array(inference.CUTS) * RANGE
    edges = np.array([int(c) + i for c in cuts[:9] for i in (-1, 0, 1)])
    hashes = np.concatenate([np.random.default_rng(3).integers(0, RANGE, 300), edges[edges < RANGE]])
    want = np.searchsorted(cuts, draw_hashes(hashes, np.arange(1, 501)).ravel(), "right").reshape(-1, 500)
    assert (inference.Draws(500, len(hashes)).weights(hashes) == want).all()
    rows = spark.range(300).selectExpr("id AS k", "id % 7 * 1.5 AS v", "explode(array('a', 'b', if(id % 3 = 0, 'c', 'b'))) AS g").coalesce(1)
    got = inference.boot_sums(rows, ["g"], "k", {"s": F.col("v")}, 40, 5, rows_drawn="d")
    plain = inference.boot_weights(rows, "k", 40, 5).groupBy("g", "rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.count(F.lit(1)).alias("d"))
    seen = lambda df: {(r["g"], r["rep"]): (r["n"], round(float(r["s"]), 6), r["d"]) for r in df.where("n > 0").collect()}
    assert seen(got) == seen(plain)
    assert "Exchange" in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]  # one file's rows go to all cores


def test_a_domain_is_split_by_ranges(spark):
    from siteweave.operators import folds

    rows = spark.range(400).selectExpr("id AS k", "if(id % 11 = 0, null, if(id < 300, 'a', 'b')) AS d")
    got = folds.split_within(rows, "d", 3)
    assert "row_number() windowspecdefinition(d#" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in rows.withColumn("h", folds.portable_hash(F.col("k"), 3)).collect():
        want.setdefault(r["d"], []).append((r["h"], r["k"]))
    tests = {k for v in want.values() for _, k in sorted(v)[: int(0.2 * len(v) + 0.5)]}
    assert {r["k"] for r in got.where("split = 'test'").collect()} == tests and got.count() == 400
