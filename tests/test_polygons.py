"""Polygons by cells: the same points as over whole rings, and few edges for each point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import joins


def star(n, x, y, r, seed):
    rng = np.random.default_rng(seed)
    a = np.arange(n) * 2 * math.pi / n
    d = r * (0.4 + 0.6 * rng.random(n))
    return np.column_stack([x + d * np.cos(a), y + d * np.sin(a)])


def comb(n):
    """Long teeth, most ends at the same few heights."""
    return np.array([(i * 0.25, 2.0 if i % 2 else 0.5 * (i % 3)) for i in range(n)] + [(n * 0.25, -1.0), (-1.0, -1.0)])


def inside(px, py, rings):
    c = 0
    for v in rings:
        x1, y1 = v.T
        x2, y2 = np.roll(v, -1, axis=0).T
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
            c += int((((y1 > py) != (y2 > py)) & (px < at)).sum())
    return c % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    box = np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    return {1: [star(700, 3, 3, 5, 1)], 2: [box], 3: [star(300, 2, 2, 3, 2), star(90, 2, 2, 0.8, 3)], 4: [comb(200)], 5: [star(65, 170, 80, 9, 4)]}


def polygons(spark, shapes):
    rows = [(p, f"p{p}", r, i, float(x), float(y)) for p, rings in shapes.items() for r, v in enumerate(rings) for i, (x, y) in enumerate(v)]
    return joins.polygons(spark.createDataFrame(rows, "poly_id int, name string, ring int, vi int, x double, y double").repartition(4), carry=["name"])


def test_points_equal_whole_rings(spark, shapes):
    rng = np.random.default_rng(5)
    at = np.vstack([rng.uniform(-3, 9, (500, 2)), rng.uniform((160, 70), (180, 90), (60, 2)), *[v[::9] for rings in shapes.values() for v in rings], rng.integers(-2, 9, (60, 2)) / 2])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)] + [(9999, None, 1.0)], "id long, longitude double, latitude double").repartition(3)
    polys = polygons(spark, shapes)
    want = sorted((i, p) for i, (a, b) in enumerate(at) for p, rings in shapes.items() if inside(a, b, rings))
    got = joins.pip_join(points, polys, "inner")
    assert sorted((r["id"], r["poly_id"]) for r in got.collect()) == want and len({p for _, p in want}) == 5
    left = joins.pip_join(points, polys).collect()
    assert sorted((r["id"], r["poly_id"]) for r in left if r["poly_id"]) == want
    none = {r["id"] for r in left if r["poly_id"] is None}
    assert none == {*range(len(at)), 9999} - {i for i, _ in want} and len(left) == len(want) + len(none)
    assert joins.pip_join(points, polys.limit(0)).where("name is null").count() == points.count()
    assert joins.pip_join(points, polys.limit(0), "inner").count() == 0


def test_a_large_ring_costs_a_cell_its_own_edges(spark):
    n = 100_000
    v = star(n, 10, 50, 5, 7)
    cells = joins.polygon_cells(polygons(spark, {1: [v]}))
    r = cells.agg(F.count(F.lit(1)).alias("cells"), F.avg(F.size("edges")).alias("mean"), F.max(F.size("steps")).alias("steps")).first()
    assert r["cells"] < 2 * n and r["mean"] < n / 500 and cells.where("size(edges) = 0 and odd").count() > 50
    points = spark.createDataFrame([(float(10 + 3 * math.cos(i)), float(50 + 3.2 * math.sin(1.7 * i))) for i in range(40)], "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]) for r in joins.pip_join(points, polygons(spark, {1: [v]}), "inner").collect()}
    assert got == {(a, b) for a, b in ((r["longitude"], r["latitude"]) for r in points.collect()) if inside(a, b, [v])} and got
