"""Queries over pixel tables and pixel time series."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import aggregates, raster
from ..session import shared_folder
from .registry import query, rounded

CLASSES = [10, 20, 30, 40, 90, 95, 100]
CLEAR = "coalesce(scl, 0) NOT IN (0, 1, 2, 3, 8, 9)"
NDVI = f"CASE WHEN {CLEAR} THEN (b8 - b4) / (b8 + b4) END"


@query("S14_validate_tiles", "f_pixels", sql="SELECT tile, yr, count(*) AS n, count(value) AS n_valid, count(*) = (SELECT count(*) FROM f_pixels WHERE tile = 0 AND yr = 2017) AND max(value) <> 0 AND count(value) >= 0.99 * count(*) AS ok FROM f_pixels GROUP BY tile, yr")
def _(p):
    n = p.where("tile = 0 AND yr = 2017").count()
    return raster.validate_tiles(p, ["tile", "yr"], n, least_density=0.99)


@query("P8_class_mask", "f_pixels", sql="SELECT tile, yr, round(100 * avg(CASE WHEN land_cover_class IN (10,20,30,40,90,95,100) THEN 0e0 ELSE 1e0 END), 6) AS percent_masked FROM f_pixels GROUP BY tile, yr")
def _(p):
    return rounded(raster.class_mask(p, "land_cover_class", CLASSES, ["tile", "yr"])[1])


@query("J8_sample_grid", "f_samples", "f_pixels", sql="SELECT s.sample_id, nullif(p.value, 10) AS value FROM f_samples s LEFT JOIN (SELECT * FROM f_pixels WHERE yr = 2017) p ON p.row_i = floor((60 - s.latitude) / 0.75e0) AND p.col_i = floor((s.longitude - 5) / 0.75e0)")
def _(s, p):
    return raster.sample_grid(s.select("sample_id", "latitude", "longitude"), p.where("yr = 2017"), 60.0, 5.0, 0.75, 10.0).select("sample_id", "value")


@query("A3_temporal_stats", "f_obs", sql="SELECT pixel, round(avg(v), 6) AS b8_mean, round(stddev_pop(v), 6) AS b8_sd, round(quantile_cont(v, 0.1), 6) AS b8_p10, round(quantile_cont(v, 0.5), 6) AS b8_median, round(quantile_cont(v, 0.9), 6) AS b8_p90 FROM (SELECT pixel, CASE WHEN " + CLEAR + " THEN CAST(b8 AS DOUBLE) END AS v FROM f_obs) GROUP BY pixel")
def _(o):
    return rounded(raster.temporal_stats(o, ["pixel"], ["b8"], spectral.is_clear(F.col("scl"))))


@query("A4_index_stats", "f_obs", sql=f"SELECT pixel, round(avg(v), 6) + 0e0 AS ndvi_mean, round(stddev_pop(v), 6) AS ndvi_sd, round(quantile_cont(v, 0.1), 6) + 0e0 AS ndvi_p10, round(quantile_cont(v, 0.5), 6) + 0e0 AS ndvi_median, round(quantile_cont(v, 0.9), 6) + 0e0 AS ndvi_p90, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) AS ndvi_amplitude FROM (SELECT pixel, {NDVI} AS v FROM f_obs) GROUP BY pixel")
def _(o):
    v = spectral.vegetation_indices(*[F.col(c) for c in ("b2", "b3", "b4", "b8", "b12")])
    return rounded(raster.index_stats(o, ["pixel"], {"ndvi": v["ndvi"]}, spectral.is_clear(F.col("scl"))))


@query("A5_phenology", "f_obs", sql=f"WITH o AS (SELECT pixel, seq, doy, {NDVI} AS v FROM f_obs), s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY pixel ORDER BY seq)) AS step, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY pixel ORDER BY v DESC NULLS LAST, seq) END AS a, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY pixel ORDER BY v ASC NULLS LAST, seq) END AS z FROM o) SELECT pixel, max(doy) FILTER (WHERE a = 1) AS doy_max, max(doy) FILTER (WHERE z = 1) AS doy_min, round(coalesce(sum(v), 0e0), 6) + 0e0 AS integral, round(avg(step), 6) AS roughness FROM s GROUP BY pixel")
def _(o):
    v = spectral.vegetation_indices(*[F.col(c) for c in ("b2", "b3", "b4", "b8", "b12")])["ndvi"]
    return rounded(raster.phenology(o, ["pixel"], F.when(spectral.is_clear(F.col("scl")), v)))


@query("W4_successive_diff", "f_obs", sql="SELECT seq, b8 - lag(b8) OVER (PARTITION BY pixel ORDER BY seq) AS d FROM f_obs")
def _(o):
    from pyspark.sql import Window

    return o.select("seq", (F.col("b8") - F.lag("b8").over(Window.partitionBy("pixel").orderBy("seq"))).alias("d"))


@query("A6_sar_stats", "f_obs", sql="SELECT pixel, " + ", ".join(f"round(avg({p}) FILTER (WHERE orbit = '{o}' AND NOT (vv = 0 AND vh = 0)), 6) AS {p}_{o}_mean, round(quantile_cont({p}, 0.5) FILTER (WHERE orbit = '{o}' AND NOT (vv = 0 AND vh = 0)), 6) AS {p}_{o}_median, round(stddev_pop({p}) FILTER (WHERE orbit = '{o}' AND NOT (vv = 0 AND vh = 0)), 6) AS {p}_{o}_sd" for o in ("ascending", "descending") for p in ("vv", "vh")) + " FROM f_obs GROUP BY pixel")
def _(o):
    return rounded(raster.sar_stats(o, ["pixel"]))


@query("A11_mosaic_first_valid", "f_obs", sql=f"WITH r AS (SELECT pixel, obs_date, b4, b8, row_number() OVER (PARTITION BY pixel, obs_date ORDER BY tile_idx, seq) AS n FROM f_obs WHERE {CLEAR}), k AS (SELECT DISTINCT pixel, obs_date FROM f_obs) SELECT k.pixel, k.obs_date, coalesce(CAST(r.b4 AS DOUBLE), 0e0) AS b4, coalesce(CAST(r.b8 AS DOUBLE), 0e0) AS b8 FROM k LEFT JOIN r ON k.pixel = r.pixel AND k.obs_date = r.obs_date AND r.n = 1")
def _(o):
    return raster.mosaic_first_valid(o.withColumn("at", F.struct("tile_idx", "seq")), ["pixel", "obs_date"], ["b4", "b8"], "at", spectral.is_clear(F.col("scl")))


@query("A12_coverage", "f_obs", sql=f"SELECT obs_date, round(100 * avg(CASE WHEN {CLEAR} THEN 1e0 ELSE 0e0 END), 6) AS percent, count(*) AS n FROM f_obs GROUP BY obs_date HAVING 100 * avg(CASE WHEN {CLEAR} THEN 1e0 ELSE 0e0 END) >= 60")
def _(o):
    return rounded(raster.coverage(o, ["obs_date"], spectral.is_clear(F.col("scl")), 60))


RADAR = "SELECT obs_date, orbit, count(*) AS n, 100 * avg(CASE WHEN vv > 0 THEN 1e0 ELSE 0e0 END) AS vv_percent, 100 * avg(CASE WHEN vh > 50 THEN 1e0 ELSE 0e0 END) AS vh_percent FROM f_obs GROUP BY obs_date, orbit"


@query("A12_radar_coverage", "f_obs", sql=f"WITH g AS ({RADAR}) SELECT obs_date, orbit, n, round(vv_percent, 6) AS vv_percent, round(vh_percent, 6) + 0e0 AS vh_percent, vv_percent >= 80 AS vv_kept, vh_percent >= 80 AS vh_kept FROM g WHERE vv_percent >= 80 OR vh_percent >= 80")
def _(o):
    return rounded(raster.band_coverage(o.withColumn("vh", F.when(F.col("vh") > 50, F.col("vh"))), ["obs_date", "orbit"], ["vv", "vh"], 80.0))


@query("A12_covered_bands", "f_obs", sql=f"WITH d AS (SELECT obs_date FROM f_obs GROUP BY obs_date HAVING 100 * avg(CASE WHEN {CLEAR} THEN 1e0 ELSE 0e0 END) >= 60) SELECT obs_date, count(*) AS n, round(sum(b4), 6) AS b4 FROM f_obs JOIN d USING (obs_date) GROUP BY obs_date")
def _(o):
    path = os.path.join(shared_folder(o.sparkSession), f"bands-{uuid.uuid4().hex}")
    o.select("pixel", "b4", "obs_date").repartition("obs_date").write.partitionBy("obs_date").parquet(path)
    covered = raster.covered_bands(o.sparkSession.read.parquet(path), o.select("obs_date", "scl"), "obs_date", spectral.is_clear(F.col("scl")), 60)
    return rounded(covered.groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"), F.sum("b4").alias("b4")))


@query("A13_mosaic_first_nonzero", "f_obs", sql="WITH r AS (SELECT pixel, obs_date, orbit, vv, row_number() OVER (PARTITION BY pixel, obs_date, orbit ORDER BY seq) AS n FROM f_obs WHERE vv <> 0), k AS (SELECT DISTINCT pixel, obs_date, orbit FROM f_obs) SELECT k.pixel, k.obs_date, k.orbit, coalesce(r.vv, 0e0) AS vv FROM k LEFT JOIN r ON k.pixel = r.pixel AND k.obs_date = r.obs_date AND k.orbit = r.orbit AND r.n = 1")
def _(o):
    return raster.mosaic_first_nonzero(o, ["pixel", "obs_date", "orbit"], "vv", "seq")


@query("A14_merge_tiles", "f_pixels", sql="SELECT row_i, col_i, coalesce(max(value) FILTER (WHERE yr = 2017), max(value) FILTER (WHERE yr = 2024), 0e0) AS value FROM f_pixels GROUP BY row_i, col_i")
def _(p):
    return raster.mosaic_first_valid(p, ["row_i", "col_i"], ["value"], "yr", F.col("value").isNotNull())


@query("A15_map_summary", "f_pixels", sql="SELECT tile, yr, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS least, max(value) AS most, count(value) AS n FROM f_pixels GROUP BY tile, yr")
def _(p):
    return rounded(raster.map_summary(p, ["tile", "yr"]))


@query("A35_status_summary", "documents", sql="SELECT lang AS status, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang")
def _(d):
    from ..operators.ranking import status_summary

    return rounded(status_summary(d, "lang").withColumnRenamed("lang", "status"))


@query("A36_group_scenes", "f_scenes", sql="SELECT CAST(dt AS DATE) AS day, orbit, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item FROM f_scenes GROUP BY 1, 2")
def _(s):
    return raster.group_scenes(s, True)


@query("A36_scene_boxes", "f_scenes", sql="SELECT CAST(dt AS DATE) AS day, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item, min(item_id % 50) * 1e0 AS west, min(item_id % 31) * 1e0 AS south, max(item_id % 50 + 2) * 1e0 AS east, max(item_id % 31 + 3) * 1e0 AS north FROM f_scenes GROUP BY 1")
def _(s):
    at = lambda n, more=0: ((F.col("item_id") % n + more) * 1.0)
    boxed = s.withColumns({"west": at(50), "south": at(31), "east": at(50, 2), "north": at(31, 3)})
    return raster.group_scenes(boxed, box=("west", "south", "east", "north"))


@query("J12_window_join", "f_pixels", sql="SELECT c.yr, c.row_i, c.col_i, sum(n.value * (3 * (n.row_i - c.row_i + 1) + (n.col_i - c.col_i + 1) + 1)) AS checksum FROM f_pixels c JOIN f_pixels n ON c.yr = n.yr AND abs(n.row_i - c.row_i) <= 1 AND abs(n.col_i - c.col_i) <= 1 GROUP BY c.yr, c.row_i, c.col_i HAVING count(n.value) = 9")
def _(p):
    w = raster.windows(p, 3, ["yr"])
    return w.select("yr", "row_i", "col_i", F.aggregate(F.transform("patch", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v).alias("checksum"))


PATCH = "SELECT c.row_i * 1000 + c.col_i AS id, sum(coalesce({v}, 0) * (3 * d.r + d.c + 1)) AS checksum FROM p c CROSS JOIN (SELECT r, c FROM range(3) a(r), range(3) b(c)) d LEFT JOIN p n ON n.row_i = c.row_i + d.r - 1 AND n.col_i = c.col_i + d.c - 1 {on} WHERE c.value IS NOT NULL GROUP BY c.row_i, c.col_i {having}"


def checksum(patches):
    return patches.select("id", F.aggregate(F.transform("patch", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v).alias("checksum"))


def points(p):
    return p.select((F.col("row_i") * 1000 + F.col("col_i")).alias("id"), "row_i", "col_i", "tile")


@query("J13_patches_neighbors", "f_pixels", sql="WITH p AS (SELECT * FROM f_pixels WHERE yr = 2017) " + PATCH.format(v="n.value", on="", having="HAVING count(n.value) = 9"))
def _(p):
    p = p.where("yr = 2017")
    return checksum(raster.extract_patches(points(p), p, 3, "id"))


@query("J14_patches_pad", "f_pixels", sql="WITH p AS (SELECT * FROM f_pixels WHERE yr = 2017) " + PATCH.format(v="n.value", on="AND n.tile = c.tile", having=""))
def _(p):
    p = p.where("yr = 2017")
    return checksum(raster.extract_patches(points(p), p, 3, "id", "pad"))


def target_size(p, scale: float) -> tuple[int, int]:
    """Rows and columns of a target grid of this scale that covers all pixels."""
    h, w = p.agg(F.max("row_i"), F.max("col_i")).first()
    return tuple(math.ceil(((n if n is not None else -1) + 1) / scale) for n in (h, w))


@query("M17_regrid_nearest", "f_pixels", sql="WITH s AS (SELECT 2 * max(row_i) + 2 AS h, 2 * max(col_i) + 2 AS w FROM f_pixels), a AS (SELECT unnest(range(h)) AS r FROM s), b AS (SELECT unnest(range(w)) AS c FROM s) SELECT r, c, value FROM (SELECT r, c FROM a, b) g LEFT JOIN (SELECT * FROM f_pixels WHERE yr = 2017) p ON p.row_i = floor((r + 0.5) * 0.5) AND p.col_i = floor((c + 0.5) * 0.5)")
def _(p):
    return raster.regrid(p.where("yr = 2017"), *target_size(p, 0.5), 0.5)


@query("M17_regrid_bilinear", "f_pixels", sql="WITH s AS (SELECT CAST(ceil((max(row_i) + 1) / 0.8e0) AS BIGINT) AS h, CAST(ceil((max(col_i) + 1) / 0.8e0) AS BIGINT) AS w FROM f_pixels), a AS (SELECT unnest(range(h)) AS r FROM s), b AS (SELECT unnest(range(w)) AS c FROM s), g AS (SELECT r, c, (r + 0.5e0) * 0.8e0 - 0.5e0 AS y, (c + 0.5e0) * 0.8e0 - 0.5e0 AS x FROM a, b), k AS (SELECT r, c, floor(y) + i AS yy, floor(x) + j AS xx, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM g, range(2) a(i), range(2) b(j)) SELECT r, c, round(sum(w * value) / nullif(sum(w) FILTER (WHERE value IS NOT NULL), 0), 6) AS value FROM k LEFT JOIN (SELECT * FROM f_pixels WHERE yr = 2017) p ON p.row_i = yy AND p.col_i = xx GROUP BY r, c")
def _(p):
    return rounded(raster.regrid(p.where("yr = 2017"), *target_size(p, 0.8), 0.8, "bilinear"))


@query("F13_slope_aspect", "f_pixels", sql="WITH p AS (SELECT * FROM f_pixels WHERE yr = 2017), w AS (SELECT c.row_i, c.col_i, sum(n.value * (n.col_i - c.col_i) * (CASE WHEN n.row_i = c.row_i THEN 2 ELSE 1 END)) / 8 AS dx, sum(n.value * (n.row_i - c.row_i) * (CASE WHEN n.col_i = c.col_i THEN 2 ELSE 1 END)) / 8 AS dy FROM p c JOIN p n ON abs(n.row_i - c.row_i) <= 1 AND abs(n.col_i - c.col_i) <= 1 GROUP BY c.row_i, c.col_i HAVING count(n.value) = 9) SELECT row_i, col_i, round(sqrt(dx * dx + dy * dy), 6) AS slope FROM w")
def _(p):
    return rounded(raster.slope_aspect(p.where("yr = 2017"), []).select("row_i", "col_i", "slope"))


@query("F16_minmax", "f_pixels", sql="SELECT row_i, col_i, yr, round((value - (SELECT min(value) FROM f_pixels)) / (SELECT max(value) - min(value) FROM f_pixels), 6) AS value FROM f_pixels")
def _(p):
    return rounded(raster.minmax(p, ["value"]).select("row_i", "col_i", "yr", "value"))


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"


@query("A24_embedding_drift", "embeddings", sql="WITH e AS (SELECT vec_id, embedding AS a, list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) + CASE WHEN i % 2 = 0 THEN 0.01e0 ELSE -0.02e0 END) AS b FROM embeddings), d AS (SELECT vec_id, " + DOT.format(a="a", b="b") + " AS ab, " + DOT.format(a="a", b="a") + " AS aa, " + DOT.format(a="b", b="b") + " AS bb FROM e) SELECT round(avg(ab / sqrt(aa * bb)), 5) AS cosine_mean, round(quantile_cont(ab / sqrt(aa * bb), 0.05), 5) AS cosine_p05, round(avg(sqrt(greatest(aa - 2 * ab + bb, 0)) / (sqrt(aa) + 1e-9)), 4) AS relative_l2_mean, count(*) AS n FROM d")
def _(e):
    later = F.transform("embedding", lambda v, i: v.cast("double") + F.when(i % 2 == 1, 0.01).otherwise(-0.02))
    years = e.select("vec_id", F.lit(2017).alias("year"), F.transform("embedding", lambda v: v.cast("double")).alias("v")).union(e.select("vec_id", F.lit(2024), later))
    out = aggregates.drift(years, "vec_id", "year", "v", 2017, 2024)
    return rounded(out.withColumn("relative_l2_mean", F.round("relative_l2_mean", 4)), 5)
