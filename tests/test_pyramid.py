"""Nearest places and counts within radii against brute force, with isolated and clustered places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import joins, pyramid


def distances(a, b):
    la, lo = (np.radians(x[:, i])[:, None] for i, x in ((0, a), (1, a)))
    lb, ob = (np.radians(b[:, i])[None] for i in (0, 1))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - lo) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    dense = np.column_stack([45 + rng.normal(size=1500) * 0.01, 9 + rng.normal(size=1500) * 0.01])
    lone = np.column_stack([rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200)])
    edges = np.array([[90, 0], [-90, 10], [89.9, 179.99], [89.9, -179.99], [0, 180], [0, -180]], float)
    return np.vstack([dense, lone, edges, dense[:5]])


def frame(spark, places, more=()):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(places)] + [*more]
    return spark.createDataFrame(rows, "id long, lat double, lon double").repartition(3)


def test_nearest_places_equal_brute_force(spark, world):
    test, train = world[::2], world[1::2]
    nowhere = [(9999, None, 1.0), (9998, float("nan"), 1.0)]
    got = {r["id"]: r for r in joins.nn_distance(frame(spark, test, nowhere), frame(spark, train, nowhere), compared=True).collect()}
    want = distances(test, train).min(1)
    assert sorted(got) == list(range(len(test))) and all(abs(got[i]["nn_km"] - want[i]) < 1e-8 for i in got)
    # Far fewer places are compared than there are.
    assert np.mean([r["compared"] for r in got.values()]) < 0.5 * len(train)
    assert joins.nn_distance(frame(spark, test), frame(spark, train).limit(0)).count() == 0
    assert joins.nn_distance(frame(spark, test).limit(0), frame(spark, train)).count() == 0


def test_one_search_serves_all_folds(spark, world):
    df = frame(spark, world).withColumn("fold", F.when(F.col("id") == 7, None).otherwise(F.col("id") % 3).cast("int"))
    got = {r["id"]: r["nn_km"] for r in joins.nn_other_group(df, "fold").collect()}
    ids, d = np.arange(len(world)), distances(world, world)
    assert sorted(got) == [i for i in ids if i != 7]
    assert all(abs(got[i] - d[i][(ids % 3 != i % 3) & (ids != 7)].min()) < 1e-8 for i in got)
    assert joins.nn_other_group(df.where("fold = 1"), "fold").count() == 0


def test_counts_equal_brute_force_and_dense_cells_count_at_once(spark, world):
    radii = [0.5, 10.0, 5000.0, 30000.0]
    got = {r["id"]: [r[f"n_{k:g}"] if "." not in f"{k:g}" else r[f"n_{k:g}"] for k in radii] for r in joins.neighbour_counts(frame(spark, world, [(9999, None, 1.0)]), radii).collect()}
    d = distances(world, world)
    assert got.pop(9999) == [0] * 4
    assert got == {i: [int((d[i] <= k).sum()) - 1 for k in radii] for i in range(len(world))}
    work = pyramid.counts_within(frame(spark, world[:1500]), [10.0]).agg(F.sum("compared"), F.min("n")).first()
    assert tuple(work) == (0, 1500)  # everything is within 10 km, and no place is compared
