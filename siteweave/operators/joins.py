"""Attribute and spatial joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, in_ring
from ..session import stored
from . import pyramid
from .skew import hub_join


def assemble_sources(samples: DataFrame, sources: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Samples that every source covers, with the sources' columns."""
    for s in sources:
        samples = samples.join(s, key)
    return samples


def attach(samples: DataFrame, other: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(other, key, "left")


def correlation_frame(samples: DataFrame, patches: DataFrame, others: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Inner join with patches, left joins with the others, then rows without any null."""
    out = samples.join(patches, key)
    for o in others:
        out = out.join(o, key, "left")
    return out.dropna("any")


def first_source(keys: DataFrame, sources: DataFrame, key: str, priority: str = "priority", path: str = "path", complete: str = "complete") -> DataFrame:
    """(key, path, reason): the complete entry of the first source, else why there is none."""
    best = sources.groupBy(key).agg(F.expr(f"min_by({path}, {priority}) FILTER (WHERE {complete})").alias("path"), F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("n").isNull(), "no entry").when(F.col("path").isNull(), "incomplete")
    return keys.select(key).join(best, key, "left").select(key, "path", reason.alias("reason"))


def polygons(vertices: DataFrame, key: str = "poly_id", carry: list[str] | None = None) -> DataFrame:
    """A row for each polygon with its edges and bounding box, from ordered vertices (x, y, vi; ring, if there are several)."""
    carry = carry or []
    ring = ["ring"] if "ring" in vertices.columns else []
    w = Window.partitionBy(key, *ring).orderBy("vi")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.withColumns({"x2": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "y2": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    edge = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return edges.groupBy(key, *carry).agg(F.collect_list(edge).alias("edges"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


#: Edges up to which a polygon is taken whole to the few cells that its box meets.
WHOLE_EDGES = 64
#: Edges for each cell of a larger polygon, on the average.
CELL_EDGES = 8
_BOX = ("edges", "x0", "x1", "y0", "y1")
_CELLS = "edges array<struct<x1:double,y1:double,x2:double,y2:double>>, steps array<double>, odd boolean"


def _row_cells(size: float, row: int, edges: np.ndarray) -> list[tuple]:
    """(column, edges near, steps, odd) of the cells of one row of cells that a point can be inside in.

    A ray to the right from a point of a cell crosses edges near it as it may, none to the left of the
    cell, and every edge to the right of it that has the point's height between its ends. The latter is
    the parity of the ends that are higher than the point, in which ends that two of the edges share
    cancel: what is left are a few heights (steps), of which those above the row make odd. So a cell
    has the edges that pass it, and the rule decides exactly as over the whole ring.
    """
    low, high = row * size, (row + 1) * size
    x1, y1, x2, y2 = edges.T
    at = lambda y: np.clip(x1 + (x2 - x1) * np.clip((y - y1) / (y2 - y1), 0, 1), np.minimum(x1, x2), np.maximum(x1, x2))
    a, b = at(np.clip(low, np.minimum(y1, y2), np.maximum(y1, y2))), at(np.clip(high, np.minimum(y1, y2), np.maximum(y1, y2)))
    slack = 1e-9 * (1 + np.abs(a) + np.abs(b))
    first = np.floor((np.minimum(a, b) - slack) / size).astype(np.int64)
    last = np.floor((np.maximum(a, b) + slack) / size).astype(np.int64)
    order = np.argsort(-first, kind="stable")
    out, right, heights, odd = [], 0, {}, False
    for column in range(int(last.max()), int(first.min()) - 1, -1):
        while right < len(order) and first[order[right]] > column:
            for y in (y1[order[right]], y2[order[right]]):
                if y >= high:
                    odd = not odd
                elif y > low:
                    heights[y] = not heights.pop(y, False)
                    if not heights[y]:
                        del heights[y]
            right += 1
        near = np.flatnonzero((first <= column) & (column <= last))
        if len(near) or heights or odd:
            out.append((column, [tuple(map(float, edges[i])) for i in near], sorted(heights), odd))
    return out


def polygon_cells(polys: DataFrame) -> DataFrame:
    """The cells of polygons (as polygons() makes them): their other columns, level, cx, cy, edges, steps and odd.

    A cell of level L is 2^-L degrees wide. A polygon of at most WHOLE_EDGES edges has the cells that
    its box meets, each with all its edges, at a level where that are few. A larger one has a level
    by its own density; its edges are dealt by rows of cells, clipped, and each row makes its cells
    (_row_cells): those with edges, and those inside without any.
    """
    names = [c for c in polys.columns if c not in _BOX]
    n, w, h = F.size("edges"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    span = F.greatest(w, h, F.lit(1e-9))
    level = lambda size: F.least(F.lit(30), F.greatest(F.lit(-9), F.floor(-F.log2(size)))).cast("int")
    cell = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("level")))
    small = polys.where(n <= WHOLE_EDGES).withColumn("level", level(span))
    small = small.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    small = small.select(*names, "level", "cx", "cy", "edges", F.array().cast("array<double>").alias("steps"), F.lit(False).alias("odd"))
    size = F.greatest(F.sqrt(F.greatest(w, F.lit(1e-9)) * F.greatest(h, F.lit(1e-9)) * CELL_EDGES / n), span / n)
    large = polys.where(n > WHOLE_EDGES).withColumn("level", level(size) + 1).select(*names, "level", F.explode("edges").alias("e")).select(*names, "level", "e.*").where("y1 <> y2")
    large = large.withColumns({"__a": F.least("y1", "y2"), "__b": F.greatest("y1", "y2")}).withColumn("cy", F.explode(F.sequence(cell("__a"), cell("__b"))))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in polys.dtypes if c in names), f"level int, cx bigint, cy bigint, {_CELLS}"])

    def row(p: pd.DataFrame) -> pd.DataFrame:
        head = p.iloc[0]
        got = _row_cells(2.0 ** -int(head["level"]), int(head["cy"]), p[["x1", "y1", "x2", "y2"]].to_numpy(np.float64))
        out = pd.DataFrame({"cx": [g[0] for g in got], "edges": [[dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in g[1]] for g in got], "steps": [g[2] for g in got], "odd": [g[3] for g in got]})
        return out.assign(**{c: head[c] for c in (*names, "level", "cy")})[[*names, "level", "cx", "cy", "edges", "steps", "odd"]]

    return small.unionByName(large.groupBy(*names, "level", "cy").applyInPandas(row, schema))


def pip_join(points: DataFrame, polys: DataFrame, how: str = "left", x: str = "longitude", y: str = "latitude", first_only: bool = False) -> DataFrame:
    """Points with the polygons they lie in, by the even-odd rule. polys as polygons() makes it.

    With first_only the candidates are sought once for each place, and every row of it gets them.
    Points meet polygons in cells (polygon_cells), so a point is compared with the edges that pass its
    own cell and not with whole rings. A point in several polygons gives several rows, or with first_only
    the one with the smallest poly_id; how="left" keeps points in none.
    """
    if first_only:
        names = [c for c in polys.columns if c not in (*_BOX, *points.columns)]
        at = points.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
        first = pip_join(at, polys, "inner", x, y).groupBy(x, y).agg(F.min_by(F.struct(*names), "poly_id").alias("__first"))
        first = first.withColumnsRenamed({x: "__x", y: "__y"})
        return points.join(first, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), how).select(*points.columns, *[F.col(f"__first.{c}").alias(c) for c in names])
    names = [c for c in polys.columns if c not in _BOX]
    extra = [c for c in names if c not in points.columns]
    cells = stored(polygon_cells(polys).select(*extra, *[F.col(c).alias(f"__{c}") for c in ("level", "cx", "cy", "edges", "steps", "odd")]))
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())  # 40 at most
    if not levels:
        return points.join(cells.select(*extra), F.lit(False), how) if how == "left" else points.join(cells.select(*extra), F.lit(True), "cross").limit(0)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    at = F.array(*[F.struct(F.lit(n).alias("l"), F.floor(px * 2.0**n).alias("i"), F.floor(py * 2.0**n).alias("j")) for n in levels])
    # Points in no polygon are found again by number, which is stored as it must not change.
    numbered = stored(points.withColumn("__point", F.monotonically_increasing_id())) if how == "left" else points.withColumn("__point", F.lit(0))
    placed = numbered.withColumn("__at", F.explode(at))
    above = F.size(F.filter("__steps", lambda s: s > py)) + F.when(F.col("__odd"), 1).otherwise(0)
    inside = (above + F.when(in_ring(px, py, F.col("__edges")), 1).otherwise(0)) % 2 == 1
    met = (F.col("__at.l") == F.col("__level")) & (F.col("__at.i") == F.col("__cx")) & (F.col("__at.j") == F.col("__cy")) & inside
    hits = placed.join(cells, met).select(*points.columns, "__point", *extra)
    if how != "left":
        return hits.drop("__point")
    return numbered.join(hits.select("__point", *extra), "__point", "left").select(*points.columns, *extra)


def within_radius(a: DataFrame, b: DataFrame, km: float, key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(a, b, km): pairs of points of two tables (key, lat, lon) not further apart than km.

    Points meet in latitude bands and in the longitude cells of a band, whose width fits the band's
    highest latitude; b is copied into the neighbouring cells, around the antimeridian too. Near the
    poles a band has one cell.
    """
    step = math.degrees(km / EARTH_KM) * 1.0000001 + 1e-12
    band = lambda c: F.floor(F.col(c) / step)

    def columns(i):
        top = F.least(F.lit(90.0), F.greatest(F.abs(i * step), F.abs((i + 1) * step)))
        ratio = F.sin(F.radians(F.lit(step))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))
        width = F.when(ratio < 0.5, F.degrees(F.asin(F.least(F.lit(0.5), ratio))) * 1.0001).otherwise(F.lit(360.0))
        return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(360.0) / width))

    left = a.select(F.col(key).alias("a"), F.col(lat).alias("lat1"), F.col(lon).alias("lon1")).withColumn("i", band("lat1"))
    left = left.withColumn("n", columns(F.col("i"))).withColumn("j", F.pmod(F.floor((F.col("lon1") + 180) / 360 * F.col("n")), F.col("n")))
    right = b.select(F.col(key).alias("b"), F.col(lat).alias("lat2"), F.col(lon).alias("lon2"))
    right = right.withColumn("i", F.explode(F.sequence(band("lat2") - 1, band("lat2") + 1)))
    right = right.withColumn("n", columns(F.col("i"))).withColumn("own", F.floor((F.col("lon2") + 180) / 360 * F.col("n")))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("own") + d, F.col("n"))))
    right = right.withColumn("j", F.explode(near))
    d = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return left.join(right, ["i", "j"]).withColumn("km", d).where(F.col("km") <= km).select("a", "b", "km")


def nn_distance(test: DataFrame, train: DataFrame, key: str = "id", lat: str = "lat", lon: str = "lon", compared: bool = False) -> DataFrame:
    """(key, nn_km): each test point's distance to the nearest train point, with compared how many places it was compared with.

    Searched in a pyramid of cells, the nearest cell first (pyramid.nearest); points of one place are
    searched once. Points without a place, and all points if train has none, have no row.
    """
    found = pyramid.nearest(test, train, lat, lon)
    of = found.select(F.struct("lat", "lon").alias("__at"), F.col("w").alias("n"), "nn_km", "compared")
    return _at_places(test, of, key, lat, lon).select(key, "nn_km", *(["compared"] if compared else []))


def nn_other_group(points: DataFrame, group: str, key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, nn_km): each point's distance to the nearest point of another group (a number, as a fold is), in one search for all groups.

    Points without a place or a group, and all points if there is one group, have no row.
    """
    some = points.where(F.col(group).isNotNull())
    found = pyramid.nearest(some, some, lat, lon, group=group)
    at = some.select(key, F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(group).cast("long").alias("g")).alias("__at"))
    values = stored(found.select(F.struct("lat", "lon", "g").alias("__at"), F.col("w").alias("n"), "nn_km"))
    return hub_join(at, values, "__at", values.agg(F.sum("n")).first()[0] or 0).select(key, "nn_km")


def _at_places(points: DataFrame, values: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(key, values): points with the values of their places, (__at, n: how many points are there, more)."""
    at = points.select(key, F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).alias("__at"))
    values = stored(values)
    return hub_join(at, values, "__at", values.agg(F.sum("n")).first()[0] or 0).drop("__at")


def neighbour_counts(points: DataFrame, radii: list[float], key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, n_<km>...): the number of other points within each radius (0 for a point without a place).

    Counted in a pyramid of cells: cells that lie whole inside count at once, and only those on the
    rim are looked into (pyramid.counts_within).
    """
    found = pyramid.counts_within(points, radii, lat, lon)
    names = {f"r{i}": f"n_{r:g}" for i, r in enumerate(radii)}
    wide = found.groupBy("lat", "lon").agg(*[F.max(F.when(F.col("km") == r, F.col("n") - 1)).alias(c) for c, r in zip(names, radii, strict=True)])
    sizes = points.groupBy(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    values = wide.join(sizes, ["lat", "lon"]).select(F.struct("lat", "lon").alias("__at"), "n", *names)
    counts = _at_places(points, values, key, lat, lon)
    return points.select(key).join(counts, key, "left").na.fill(0, list(names)).withColumnsRenamed(names)


def resolve_by_segment(ids: DataFrame, files: DataFrame, key: str = "sample_id", stem: str = "stem") -> DataFrame:
    """(key, stem): the one file that has the id among the segments of its name; an id of several files has none."""
    seg = files.select(stem, F.explode(F.array_distinct(F.split(stem, "_"))).alias(key))
    one = seg.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(stem).alias(stem)).where("n = 1").drop("n")
    return ids.select(key).join(one, key)


def pair_runs(runs: DataFrame, reference: str, keys: list[str], metric: str, config: str = "config", seed: str = "run_seed") -> DataFrame:
    """Each configuration's metric beside the reference's of the same seed; no rows if the seeds differ."""
    seeds = runs.groupBy(config, *keys).agg(F.array_sort(F.collect_set(seed)).alias("s")).agg(F.count_distinct("s").alias("kinds"))
    ref = runs.where(F.col(config) == reference).select(*keys, seed, F.col(metric).alias("ref"))
    own = runs.where(F.col(config) != reference).select(config, *keys, seed, F.col(metric).alias("own"))
    return own.join(ref, [*keys, seed]).join(F.broadcast(seeds.where("kinds = 1")), how="cross").drop("kinds")  # one row or none


def domain_pairs(domains: DataFrame, column: str) -> DataFrame:
    """All ordered pairs of different domains; domains are few by their nature."""
    d = domains.select(column).distinct()
    return d.select(F.col(column).alias("source")).join(d.select(F.col(column).alias("target")), F.col("source") != F.col("target"))
