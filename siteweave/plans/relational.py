"""Queries of filters, joins, aggregates and column functions."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import arrays, geo, spectral, text
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import joins
from ..session import shared_folder
from ..sources import files, samples
from .registry import query, rounded

LABELS = {"prec": "Precipitation", "tavg": "Mean temperature"}
BOXES = [(46.0, 6.0, 50.0, 12.0), (52.0, 15.0, 58.0, 22.0)]
INSIDE = "((latitude BETWEEN 46e0 AND 50e0 AND longitude BETWEEN 6e0 AND 12e0) OR (latitude BETWEEN 52e0 AND 58e0 AND longitude BETWEEN 15e0 AND 22e0))"


@query("S1_load_samples", "f_samples", sql="SELECT sample_id, latitude, longitude, rarefied FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY part, latitude) AS n FROM (SELECT sample_id, latitude, longitude, rarefied, 0 AS part FROM f_samples WHERE k % 2 = 0 UNION ALL SELECT sample_id, latitude + 1e0, longitude, CASE WHEN k % 7 = 0 THEN NULL ELSE rarefied END, 1 FROM f_samples WHERE k % 3 <> 1) WHERE rarefied IS NOT NULL) WHERE n = 1")
def _(s):
    a = s.where("k % 2 = 0").select("sample_id", "latitude", "longitude", "rarefied")
    b = s.where("k % 3 <> 1").select("sample_id", (F.col("latitude") + 1).alias("latitude"), "longitude", F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE rarefied END").alias("rarefied"))
    return samples.unify_samples([a, b])


@query("S2_load_samples_optional", "f_samples", sql="SELECT sample_id, latitude, longitude, rarefied, CASE WHEN k % 2 = 0 THEN continent END AS continent FROM f_samples")
def _(s):
    a = s.where("k % 2 = 0").select("sample_id", "latitude", "longitude", "rarefied", "continent")
    return samples.unify_samples([a, s.where("k % 2 <> 0").select("sample_id", "latitude", "longitude", "rarefied")], optional=("continent",))


def scratch(df, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def npy_files(e):
    """(path, content) of an .npy file for each vector: 4 x 4 x 4 values; every seventh has a NaN, every eleventh lacks an axis, every thirteenth is no array file."""

    def encoded(items):
        for batch in items:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.array(v, np.float32).reshape(4, 4, 4)
                if k % 7 == 0:
                    a[0, 0, 0] = np.nan
                out.append(b"no array" if k % 13 == 0 else files.encode_npy(a[0] if k % 11 == 0 else a))
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"/patches/{k}.npy" for k in batch.column(0).to_pylist()]), "content": pa.array(out, pa.binary())})

    return e.select("vec_id", "embedding").mapInArrow(encoded, "path string, content binary")


@query("S3_ingest_patches", "embeddings", sql="SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(CASE WHEN w IS NULL THEN 4 END AS INT) AS p, CAST(CASE WHEN w IS NULL THEN 4 END AS INT) AS c, CASE WHEN w IS NULL THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0e0 END AS total, w AS reason FROM (SELECT *, CASE WHEN vec_id % 13 = 0 THEN 'unreadable: ValueError' WHEN vec_id % 11 = 0 THEN 'not three-dimensional' WHEN vec_id % 7 = 0 THEN 'not finite' END AS w FROM embeddings)")
def _(e):
    kept, skipped = files.decode_patches(npy_files(e))
    total = F.aggregate("patch", F.lit(0.0), lambda s, v: s + v.cast("double"))
    none = F.lit(None)
    rows = kept.select("sample_id", "p", "c", total.alias("total"), none.cast("string").alias("reason"))
    return rounded(rows.union(skipped.select("id", none.cast("int"), none.cast("int"), none.cast("double"), "reason")), 5)


@query("S4_feature_cache", "f_soil_raw", sql="SELECT sample_id, max(raw) FILTER (WHERE var = 'phh2o' AND depth = '0_5cm') AS phh2o, max(raw) FILTER (WHERE var = 'wrb') AS wrb FROM f_soil_raw GROUP BY sample_id")
def _(r):
    """Features written as JSON, each row twice, and read as a cache with a row for each sample."""
    at = lambda v, d: F.max(F.when((F.col("var") == v) & (F.col("depth") == d), F.col("raw"))).alias(v)
    wide = r.groupBy("sample_id").agg(at("phh2o", "0_5cm"), at("wrb", "all"))
    folder = scratch(r, "cache")
    wide.union(wide).write.json(folder)
    return files.ingest_feature_cache(r.sparkSession, folder, "sample_id string, phh2o double, wrb double")


@query("S10_bundles", "f_runs", "f_preds", sql="SELECT 'first' AS bundle, 'runs' AS \"table\", count(*) AS n, round(sum(r2), 6) AS total FROM f_runs UNION ALL SELECT 'second', 'preds', count(*), round(sum(yhat), 6) FROM f_preds UNION ALL SELECT 'second', 'runs', count(*), round(sum(rmse), 6) FROM f_runs")
def _(r, p):
    """Two bundles written, listed and read back."""
    spark, root, value = r.sparkSession, scratch(r, "bundles"), {("first", "runs"): "r2", ("second", "runs"): "rmse", ("second", "preds"): "yhat"}
    files.write_bundle(root, "first", {"runs": r})
    files.write_bundle(root, "second", {"runs": r, "preds": p})
    listed = files.list_bundles(spark, root).collect()  # a row for each table of the bundles
    each = [files.read_bundle(spark, root, b, t).agg(F.lit(b).alias("bundle"), F.lit(t).alias("table"), F.count(F.lit(1)).alias("n"), F.sum(value[b, t]).alias("total")) for b, t in listed]
    return rounded(reduce(lambda a, b: a.union(b), each))


@query("S11_exports", "f_runs", sql="SELECT kind, config, run_seed, round(r2, 6) AS r2 FROM f_runs CROSS JOIN (VALUES ('csv'), ('json')) AS t(kind)")
def _(r):
    """A report written as CSV and as JSON and read back."""
    spark, kinds = r.sparkSession, {"csv": scratch(r, "csv"), "json": scratch(r, "json")}
    for kind, path in kinds.items():
        files.export(r.select("config", "run_seed", "r2"), path, kind)
    read = spark.read.schema("config string, run_seed bigint, r2 double")
    both = [df.select(F.lit(k).alias("kind"), "*") for k, df in (("csv", read.option("header", True).csv(kinds["csv"])), ("json", spark.read.schema("config string, run_seed bigint, r2 double").json(kinds["json"])))]
    return rounded(both[0].union(both[1]))


@query("P3_split_blocks", "f_samples", "f_patch", "f_climate_monthly", sql="WITH c AS (SELECT sample_id, avg(value) FILTER (WHERE var = 'prec') AS prec, avg(value) FILTER (WHERE var = 'wind') AS wind FROM f_climate_monthly GROUP BY sample_id) SELECT s.sample_id, round(CAST(vec[1] AS DOUBLE) + vec[2], 5) + 0e0 AS satellite, round(latitude + longitude, 5) AS coords, round(coalesce(prec, 0) + coalesce(wind, 0), 5) AS environment FROM f_samples s JOIN f_patch p USING (sample_id) JOIN c USING (sample_id)")
def _(s, p, c):
    """The sum of each block's features."""
    climate = c.groupBy("sample_id").pivot("var", ["prec", "wind"]).agg(F.avg("value"))
    wide = s.select("sample_id", "latitude", "longitude").join(p.select("sample_id", *[F.col("vec")[i].cast("double").alias(f"patch_{i}") for i in (0, 1)]), "sample_id").join(climate, "sample_id")
    blocks = flt.split_blocks([x for x in wide.columns if x != "sample_id"])
    return rounded(wide.select("sample_id", *[sum((F.coalesce(F.col(x), F.lit(0.0)) for x in xs), F.lit(0.0)).alias(b) for b, xs in blocks.items()]), 5)


@query("S5_scan_registry", "f_registry", sql="SELECT CAST(year AS INT) AS year, lon_i, lat_i FROM f_registry WHERE year = 2023")
def _(r):
    path = scratch(r, "registry")
    r.write.partitionBy("year").parquet(path)
    return samples.scan_registry(r.sparkSession, path, 2023).select("year", "lon_i", "lat_i")


@query("S6_scan_runs", "f_runs", sql="SELECT CASE WHEN config LIKE 'R%' THEN 'xgboost' ELSE 'rf' END AS model, CASE WHEN config NOT LIKE 'R%' THEN config END AS config, run_seed, round(r2, 6) + 0e0 AS r2 FROM f_runs WHERE config NOT LIKE 'N%'")
def _(r):
    root = scratch(r, "runs")
    for config in [x[0] for x in r.select("config").distinct().collect()]:  # a folder for each run
        name = {"N": f"old_{config}", "R": "xgboost"}.get(config[0], f"rf_{config}_20240101-120000")
        r.where(F.col("config") == config).select("run_seed", "r2").write.mode("append").option("header", True).csv(f"{root}/{name}/metrics.csv")
    return rounded(files.scan_runs(r.sparkSession, root, "metrics.csv", "run_seed bigint, r2 double", bare="rf|lightgbm|xgboost").select("model", "config", "run_seed", "r2"))


@query("S7_scan_summaries", "f_runs", sql="SELECT config, round(avg(r2), 6) + 0e0 AS r2_mean, CASE WHEN config LIKE 'N%' THEN NULL ELSE round(avg(rmse), 4) + 0e0 END AS rmse_mean FROM f_runs GROUP BY config")
def _(r):
    root = scratch(r, "summaries")
    old = r.where("config LIKE 'N%'").groupBy("config").agg(F.avg("r2").alias("r2_mean"))
    new = r.where("config NOT LIKE 'N%'").groupBy("config").agg(F.avg("r2").alias("r2_mean"), F.round(F.avg("rmse"), 4).alias("rmse_mean"))
    for name, part in (("old", old), ("new/of_runs", new)):
        files.export(part, f"{root}/{name}", "json")
    return rounded(files.scan_summaries(r.sparkSession, root, "config string, r2_mean double, rmse_mean double", lines=True))


@query("S8_failed_ids", "documents", sql="SELECT source AS id, 'failure' AS status FROM documents WHERE text IS NOT NULL GROUP BY source HAVING NOT bool_or(contains(text, 'Étion dans'))")
def _(d):
    root = scratch(d, "logs")
    d.where("text is not null").select("source", "text").write.partitionBy("source").text(root)
    return files.failed_ids(d.sparkSession, root, "Étion dans", r"source=([^/]+)/")


@query("S8_log_status", "documents", sql="SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' WHEN contains(text, 'the') THEN 'success' ELSE 'failure' END AS status FROM documents")
def _(d):
    return files.log_status(d, "doc_id", "text", marker="the")


@query("S9_retry_list", "f_files", "f_samples", sql="SELECT sample_id FROM (SELECT DISTINCT regexp_extract(stem, '^2021_S(.+)_rerun$', 1) AS sample_id FROM f_files WHERE stem LIKE '2021%rerun') x WHERE sample_id IN (SELECT sample_id FROM f_samples WHERE k % 2 = 0)")
def _(f, s):
    lines = f.select(F.col("stem").alias("value"))
    return files.retry_ids(lines, s.where("k % 2 = 0").select("sample_id"), r"^2021_S(.+)_rerun$", "sample_id")


@query("S12_pending", "f_samples", "f_patch", sql="SELECT sample_id FROM f_samples WHERE sample_id NOT IN (SELECT sample_id FROM f_patch)")
def _(s, p):
    return flt.pending(s.select("sample_id"), p, "sample_id", F.size("vec") == 64)


@query("S12_resume", "f_obs", sql="SELECT obs_date, count(*) AS n, round(sum(b8), 6) AS b8 FROM f_obs GROUP BY obs_date")
def _(o):
    path, dates = scratch(o, "days"), o.select("obs_date").distinct()
    made = lambda todo: o.join(todo, "obs_date", "left_semi").groupBy("obs_date").agg(F.count(F.lit(1)).alias("n"), F.sum("b8").alias("b8"))
    flt.resume(dates.where(F.day("obs_date") % 2 == 0), path, "obs_date", F.col("n") > 0, made)
    return rounded(flt.resume(dates, path, "obs_date", F.col("n") > 0, made).select("obs_date", "n", "b8"))


@query("S13_coverage", "f_samples", "f_patch", "f_soil_raw", "f_landcover", sql="SELECT x.source, count(*) AS n, sum(x.hit) AS covered, round(avg(x.hit), 6) + 0e0 AS share FROM (SELECT 'patch' AS source, CASE WHEN sample_id IN (SELECT sample_id FROM f_patch) THEN 1 ELSE 0 END AS hit FROM f_samples UNION ALL SELECT 'soil', CASE WHEN sample_id IN (SELECT sample_id FROM f_soil_raw) THEN 1 ELSE 0 END FROM f_samples UNION ALL SELECT 'landcover', CASE WHEN sample_id IN (SELECT sample_id FROM f_landcover) THEN 1 ELSE 0 END FROM f_samples) x GROUP BY x.source")
def _(s, p, soil, lc):
    return rounded(samples.coverage_report(s, {"patch": p, "soil": soil, "landcover": lc}))


@query("P1_bbox_filter", "f_samples", sql=f"SELECT sample_id FROM f_samples WHERE {INSIDE}")
def _(s):
    return flt.bbox_filter(s, BOXES).select("sample_id")


@query("P1_bbox_exclude", "f_samples", sql=f"SELECT sample_id FROM f_samples WHERE NOT {INSIDE}")
def _(s):
    return flt.bbox_filter(s, BOXES, "exclude").select("sample_id")


@query("P2_valid_coords", "f_samples", sql="SELECT sample_id FROM f_samples WHERE latitude * 2e0 BETWEEN -90 AND 90 OR latitude < 45.01e0")
def _(s):
    moved = s.withColumn("latitude", F.expr("CASE WHEN latitude < 45.01e0 THEN latitude ELSE latitude * 2e0 END"))
    return flt.valid_coords(moved).select("sample_id")


@query("P4_categorize", "f_importance", sql="SELECT seed, feature, CASE WHEN feature LIKE 'wc\\_class\\_%' ESCAPE '\\' THEN 'Land Cover' WHEN feature IN ('latitude','longitude') THEN 'Location' WHEN contains(feature, '_annual_') THEN 'Climate' WHEN feature IN ('elev','slope','aspect') THEN 'Topography' WHEN starts_with(feature, 'bio_') THEN 'Bioclimatic' WHEN starts_with(feature, 'soil_') OR starts_with(feature, 'wrb_') THEN 'Soil' WHEN starts_with(feature, 'patch_') THEN 'Satellite (Raw)' WHEN starts_with(feature, 'pca_') OR starts_with(feature, 'umap_') THEN 'Satellite' ELSE 'Other' END AS category FROM f_importance")
def _(i):
    return i.select("seed", "feature", text.category(F.col("feature")).alias("category"))


@query("P5_block_of", "f_importance", sql="SELECT seed, feature, CASE WHEN starts_with(feature, 'patch_') OR starts_with(feature, 'pca_') OR starts_with(feature, 'umap_') THEN 'Satellite (SSL)' WHEN feature IN ('latitude','longitude') THEN 'Coordinates' WHEN starts_with(feature, 'soil_') OR starts_with(feature, 'wc_class') OR contains(feature, 'wrb') THEN 'Soil / land cover' ELSE 'Climate' END AS block FROM f_importance")
def _(i):
    return i.select("seed", "feature", text.block_of(F.col("feature")).alias("block"))


@query("P6_skip_ledger", "f_samples", "f_patch", sql="SELECT s.sample_id AS id, CASE WHEN p.sample_id IS NULL THEN 'missing patch' ELSE 'negative target' END AS reason, 'patches' AS stage FROM f_samples s LEFT JOIN f_patch p USING (sample_id) WHERE p.sample_id IS NULL OR s.rarefied < 0")
def _(s, p):
    joined = joins.attach(s, p)
    return flt.with_ledger(joined, "sample_id", "patches", [(F.col("vec").isNull(), "missing patch"), (F.col("rarefied") < 0, "negative target")])[1]


@query("P7_same_shape", "f_files", sql="SELECT stem FROM f_files WHERE length(stem) = (SELECT l FROM (SELECT length(stem) AS l, count(*) AS c FROM f_files GROUP BY 1) ORDER BY c DESC, l LIMIT 1)")
def _(f):
    return flt.same_shape(f.withColumn("a", F.split("stem", "")), "a").select("stem")


@query("P9_scene_filter", "f_scenes", sql="SELECT item_id FROM f_scenes WHERE cloud < 40 AND dt >= (SELECT CAST(min(CAST(dt AS DATE)) AS TIMESTAMP) FROM f_scenes) AND dt <= TIMESTAMP '2100-01-01 00:00:01' AND orbit = 'ascending'")
def _(s):
    return flt.scene_filter(s, 40, "1970-01-01", "2100-01-01", "ascending").select("item_id")


@query("P10_is_clear", "f_obs", sql="SELECT seq, coalesce(scl, 0) NOT IN (0, 1, 2, 3, 8, 9) AS clear FROM f_obs")
def _(o):
    return o.select("seq", spectral.is_clear(F.col("scl")).alias("clear"))


@query("P11_guard", "f_preds", sql="SELECT config, seed, count(*) AS n, count(DISTINCT y) AS n_distinct FROM f_preds GROUP BY config, seed HAVING count(*) >= 590 AND count(DISTINCT y) >= 2")
def _(p):
    return flt.guard(p, ["config", "seed"], 590, "y")


@query("P12_label_variables", "f_climate_monthly", sql="SELECT DISTINCT var, CASE var WHEN 'prec' THEN 'Precipitation' WHEN 'tavg' THEN 'Mean temperature' ELSE var END AS label FROM f_climate_monthly")
def _(c):
    return flt.label_variables(c.select("var").distinct(), LABELS, "var")


@query("U1_union_all", "f_samples", sql="SELECT sample_id, rarefied FROM f_samples UNION ALL SELECT sample_id, NULL FROM f_samples WHERE k % 5 = 0")
def _(s):
    return flt.union_all(s.select("sample_id", "rarefied"), s.where("k % 5 = 0").select("sample_id"))


@query("U2_common_ids", "f_registry", sql="SELECT lon_i FROM f_registry WHERE year <> 2023 OR lon_i % 20 = 5 GROUP BY lon_i HAVING count(DISTINCT year) = 3")
def _(r):
    return flt.common_keys(r.where("year <> 2023 OR lon_i % 20 = 5"), "lon_i", "year")


@query("U3_complement", "f_preds", sql="SELECT sample_k, fold FROM f_preds WHERE fold <> 2")
def _(p):
    return flt.complement(p, 2).select("sample_k", "fold")


@query("U4_tiles_needed", "f_samples", sql="SELECT DISTINCT round(floor(longitude * 10) / 10e0 + 0.05e0, 2) AS lon_t, round(floor(latitude * 10) / 10e0 + 0.05e0, 2) AS lat_t FROM f_samples")
def _(s):
    return s.select(geo.tile_centre(F.col("longitude")).alias("lon_t"), geo.tile_centre(F.col("latitude")).alias("lat_t")).distinct()


@query("W6_common_rows", "f_pixels", sql="SELECT row_i, col_i, yr FROM f_pixels WHERE value IS NOT NULL AND value < 230 AND (row_i, col_i) IN (SELECT (row_i, col_i) FROM f_pixels WHERE value IS NOT NULL AND value < 230 GROUP BY row_i, col_i HAVING count(DISTINCT yr) = 2)")
def _(p):
    kept = p.where("value IS NOT NULL AND value < 230").withColumn("at", F.struct("row_i", "col_i"))
    return flt.common_rows(kept, "at", "yr").select("row_i", "col_i", "yr")


@query("W8_keep_first", "f_landcover", sql="SELECT sample_id, seq, land_cover_class FROM f_landcover WHERE seq = 0")
def _(lc):
    return flt.keep_first(lc, ["sample_id"], ["seq"])


@query("J1_assemble_sources", "f_samples", "f_patch", "f_landcover", sql="SELECT s.sample_id, s.rarefied, l.land_cover_class FROM f_samples s JOIN f_patch p USING (sample_id) JOIN f_landcover l USING (sample_id) WHERE l.seq = 0")
def _(s, p, lc):
    return joins.assemble_sources(s, [p, flt.keep_first(lc, ["sample_id"], ["seq"])]).select("sample_id", "rarefied", "land_cover_class")


@query("J2_attach_soil", "f_samples", "f_soil_raw", sql="SELECT s.sample_id, r.raw FROM f_samples s LEFT JOIN (SELECT sample_id, raw FROM f_soil_raw WHERE var = 'clay' AND depth = '0_5cm') r USING (sample_id)")
def _(s, soil):
    return joins.attach(s, soil.where("var = 'clay' AND depth = '0_5cm'").select("sample_id", "raw")).select("sample_id", "raw")


@query("J3_correlation_frame", "f_samples", "f_patch", "f_soil_raw", "f_landcover", sql="SELECT s.sample_id, s.rarefied, r.raw, l.land_cover_class FROM f_samples s JOIN f_patch p USING (sample_id) JOIN (SELECT sample_id, raw FROM f_soil_raw WHERE var = 'clay' AND depth = '0_5cm' AND raw IS NOT NULL) r USING (sample_id) JOIN (SELECT * FROM f_landcover WHERE seq = 0) l USING (sample_id)")
def _(s, p, soil, lc):
    others = [soil.where("var = 'clay' AND depth = '0_5cm'").select("sample_id", "raw"), lc.where("seq = 0").select("sample_id", "land_cover_class")]
    return joins.correlation_frame(s.select("sample_id", "rarefied"), p, others).drop("vec")


@query("J4_restrict_missing", "f_samples", "f_patch", sql="SELECT sample_id, sample_id IN (SELECT sample_id FROM f_patch) AS present FROM f_samples")
def _(s, p):
    ids, yes = s.select("sample_id"), p.select("sample_id")
    return ids.join(yes, "sample_id", "left_semi").withColumn("present", F.lit(True)).union(ids.join(yes, "sample_id", "left_anti").withColumn("present", F.lit(False)))


@query("J5_prune_registry", "f_registry", "f_samples", sql="SELECT year, lon_i, lat_i FROM f_registry WHERE year = 2024 AND (lon_i, lat_i) IN (SELECT (CAST(floor(longitude * 10) * 10 + 5 AS BIGINT), CAST(floor(latitude * 10) * 10 + 5 AS BIGINT)) FROM f_samples)")
def _(r, s):
    return samples.prune_registry(r, s, 2024)


@query("J6_point_in_polygon", "f_samples", "f_poly_vertices", sql="""WITH e AS (SELECT poly_id, name, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM f_poly_vertices WINDOW w AS (PARTITION BY poly_id ORDER BY vi)),
h AS (SELECT s.sample_id, e.name FROM f_samples s JOIN e ON (e.y > s.latitude) <> (e.y2 > s.latitude) AND s.longitude < (e.x2 - e.x) * (s.latitude - e.y) / (e.y2 - e.y) + e.x GROUP BY s.sample_id, e.name HAVING count(*) % 2 = 1)
SELECT s.sample_id, h.name FROM f_samples s LEFT JOIN h USING (sample_id)""")
def _(s, v):
    return joins.pip_join(s, joins.polygons(v, carry=["name"])).select("sample_id", "name")


@query("J7_assign_grid_tile", "f_samples", sql="SELECT DISTINCT CAST(floor(longitude / 3e0) * 3 AS BIGINT) AS x, CAST(floor(latitude / 3e0) * 3 AS BIGINT) AS y FROM f_samples")
def _(s):
    return s.select((F.floor(F.col("longitude") / 3) * 3).alias("x"), (F.floor(F.col("latitude") / 3) * 3).alias("y")).distinct()


SITES = "SELECT site AS id, min(latitude) AS lat, min(longitude) AS lon FROM f_samples GROUP BY site"
KM = "2 * 6371.0088e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))))"


def sites(s):
    return s.groupBy(F.col("site").alias("id")).agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))


@query("J9_within_radius", "f_samples", sql=f"WITH t AS ({SITES}) SELECT a.id AS a, b.id AS b, round({KM}, 6) AS km FROM t a JOIN t b ON {KM} <= 60e0")
def _(s):
    return rounded(joins.within_radius(sites(s), sites(s), 60.0))


@query("J10_nn_distance", "f_samples", sql=f"WITH t AS ({SITES}) SELECT a.id, round(min({KM}), 6) AS nn_km FROM t a, t b WHERE a.id % 4 = 0 AND b.id % 4 = 1 GROUP BY a.id")
def _(s):
    t = sites(s)
    return rounded(joins.nn_distance(t.where("id % 4 = 0"), t.where("id % 4 = 1")))


@query("J15_resolve_by_segment", "f_samples", "f_files", sql="SELECT 'S' || s.sample_id AS seg, min(f.stem) AS stem FROM f_samples s JOIN f_files f ON f.stem LIKE '2021\\_S' || s.sample_id || '\\_%' ESCAPE '\\' GROUP BY s.sample_id HAVING count(*) = 1")
def _(s, f):
    return joins.resolve_by_segment(s.select(F.concat(F.lit("S"), "sample_id").alias("seg")), f, "seg")


@query("J16_change_map", "f_pixels", sql="SELECT a.row_i, a.col_i, b.value - a.value AS diff FROM f_pixels a JOIN f_pixels b USING (row_i, col_i) WHERE a.yr = 2017 AND b.yr = 2024")
def _(p):
    return agg.change_map(p, ["row_i", "col_i"], "yr", "value", 2017, 2024)


@query("J17_pair_runs", "f_runs", sql="SELECT o.config, o.run_seed, round(o.r2, 6) + 0e0 AS own, round(r.r2, 6) + 0e0 AS ref FROM f_runs o JOIN f_runs r USING (run_seed) WHERE o.config <> 'A_F' AND r.config = 'A_F' AND (SELECT count(DISTINCT s) FROM (SELECT string_agg(CAST(run_seed AS VARCHAR), ',' ORDER BY run_seed) AS s FROM f_runs GROUP BY config)) = 1")
def _(r):
    return rounded(joins.pair_runs(r, "A_F", [], "r2"))


@query("J18_domain_pairs", "f_samples", sql="SELECT a.c AS source, b.c AS target FROM (SELECT DISTINCT continent AS c FROM f_samples) a, (SELECT DISTINCT continent AS c FROM f_samples) b WHERE a.c <> b.c")
def _(s):
    return joins.domain_pairs(s, "continent")


@query("J20_first_source", "f_samples", "f_files", sql="SELECT s.sample_id, CASE WHEN k % 3 = 2 THEN NULL WHEN k % 3 = 1 AND k % 5 = 0 THEN NULL WHEN k % 5 = 0 THEN 'b' || s.sample_id ELSE 'a' || s.sample_id END AS path, CASE WHEN k % 3 = 2 THEN 'no entry' WHEN k % 3 = 1 AND k % 5 = 0 THEN 'incomplete' END AS reason FROM f_samples s")
def _(s, f):
    a = s.where("k % 3 <> 2").select("sample_id", F.lit(0).alias("priority"), F.concat(F.lit("a"), "sample_id").alias("path"), (F.col("k") % 5 != 0).alias("complete"))
    b = s.where("k % 3 = 0").select("sample_id", F.lit(1).alias("priority"), F.concat(F.lit("b"), "sample_id").alias("path"), F.lit(True).alias("complete"))
    return joins.first_source(s, a.union(b), "sample_id")


@query("I11_neighbour_counts", "f_samples", sql=f"WITH t AS ({SITES}) SELECT a.id, count(*) FILTER (WHERE {KM} <= 10) AS n_10, count(*) FILTER (WHERE {KM} <= 50) AS n_50 FROM t a LEFT JOIN t b ON a.id <> b.id GROUP BY a.id")
def _(s):
    return joins.neighbour_counts(sites(s), [10.0, 50.0])


@query("A1_group_stats", "f_samples", sql="SELECT biome_name, round(quantile_cont(rarefied, 0.5), 6) AS median, round(quantile_cont(rarefied, 0.25), 6) AS q25, round(quantile_cont(rarefied, 0.75), 6) AS q75, count(rarefied) AS n, round(avg(rarefied), 6) AS mean, round(stddev_samp(rarefied), 6) AS sd, round(quantile_cont(rarefied, 0.75) - quantile_cont(rarefied, 0.25), 6) AS iqr FROM f_samples GROUP BY biome_name")
def _(s):
    return rounded(agg.group_stats(s, "biome_name", "rarefied"))


@query("A2_iqr_filter", "f_samples", sql="WITH g AS (SELECT biome_name, quantile_cont(rarefied, 0.5) + 0.9e0 * (quantile_cont(rarefied, 0.75) - quantile_cont(rarefied, 0.25)) AS cut FROM f_samples GROUP BY biome_name) SELECT s.sample_id, s.biome_name FROM f_samples s JOIN g USING (biome_name) WHERE s.rarefied > g.cut")
def _(s):
    return agg.iqr_filter(s, "biome_name", "rarefied", 0.9)[1].select("sample_id", "biome_name")


@query("A7_annual_summary", "f_climate_monthly", sql="SELECT sample_id, var, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS sd FROM f_climate_monthly WHERE value IS NOT NULL GROUP BY sample_id, var")
def _(c):
    return rounded(agg.annual_summary(c))


@query("A8_soil_features", "f_soil_raw", sql="WITH p AS (SELECT sample_id, max(raw) FILTER (WHERE var='phh2o' AND depth='0_5cm') / 10 AS a, max(raw) FILTER (WHERE var='phh2o' AND depth='5_15cm') / 10 AS b, max(raw) FILTER (WHERE var='nitrogen' AND depth='0_5cm') / 100 AS c, max(raw) FILTER (WHERE var='nitrogen' AND depth='5_15cm') / 100 AS d, max(raw) FILTER (WHERE var='wrb') AS soil_wrb FROM f_soil_raw GROUP BY sample_id) SELECT sample_id, round(a, 6) AS soil_phh2o_0_5cm, round(b, 6) AS soil_phh2o_5_15cm, round(a - b, 6) + 0e0 AS soil_phh2o_gradient, round(c, 6) AS soil_nitrogen_0_5cm, round(d, 6) AS soil_nitrogen_5_15cm, round(c - d, 6) + 0e0 AS soil_nitrogen_gradient, soil_wrb FROM p")
def _(r):
    return rounded(agg.soil_features(r, ["phh2o", "nitrogen"]))


@query("A9_one_hot_class", "f_soil_raw", sql="SELECT sample_id, CASE WHEN raw IS NULL THEN 1e0 ELSE 0e0 END AS \"wrb_class_-1\", CASE WHEN raw = 1 THEN 1e0 ELSE 0e0 END AS wrb_class_1, CASE WHEN raw = 2 THEN 1e0 ELSE 0e0 END AS wrb_class_2 FROM f_soil_raw WHERE var = 'wrb'")
def _(soil):
    return agg.one_hot(soil.where("var = 'wrb'"), "raw", "wrb_class_", [1, 2], "class").drop("raw", "var", "depth")


@query("A9_one_hot", "f_landcover", sql="SELECT sample_id, seq, CASE WHEN land_cover_class = 10 THEN 1e0 ELSE 0e0 END AS wc_class_10, CASE WHEN land_cover_class = 20 THEN 1e0 ELSE 0e0 END AS wc_class_20 FROM f_landcover")
def _(lc):
    return agg.one_hot(lc, "land_cover_class", "wc_class_", [10, 20]).drop("land_cover_class")


@query("A10_impute_mean", "f_climate_monthly", sql="WITH c AS MATERIALIZED (SELECT * FROM f_climate_monthly), m AS MATERIALIZED (SELECT avg(value) AS m FROM c) SELECT sample_id, var, month, round(coalesce(value, m), 6) AS value FROM c CROSS JOIN m")
def _(c):
    return rounded(agg.impute_mean(c, ["value"]))


METRICS = "round(1 - sum((yhat - y) * (yhat - y)) / nullif(regr_syy(y, y), 0), 6) AS r2, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(abs(yhat - y)), 6) AS mae, round(quantile_cont(abs(yhat - y), 0.5), 6) AS medae, round(avg(yhat - y), 6) + 0e0 AS me, count(*) AS n"


@query("A16_regression_metrics", "f_preds", sql=f"SELECT config, seed, {METRICS} FROM f_preds GROUP BY config, seed")
def _(p):
    return rounded(agg.regression_metrics(p, ["config", "seed"]))


@query("A17_trimmed_r2", "f_preds", sql="WITH c AS (SELECT config, quantile_cont(abs(yhat - y), 0.98) AS cut FROM f_preds GROUP BY config) SELECT config, round(1 - sum((yhat - y) * (yhat - y)) / nullif(regr_syy(y, y), 0), 6) AS r2_trimmed, count(*) AS n_kept FROM f_preds JOIN c USING (config) WHERE abs(yhat - y) <= cut GROUP BY config")
def _(p):
    return rounded(agg.trimmed_r2(p, ["config"]))


@query("A18_cv_summary", "f_preds", sql="SELECT config, fold, round(1 - sum((yhat - y) * (yhat - y)) / nullif(regr_syy(y, y), 0), 6) AS r2, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, count(*) AS n FROM f_preds GROUP BY GROUPING SETS ((config, fold), (config))")
def _(p):
    return rounded(agg.cv_summary(p, "config", "fold"))


@query("A19_null_r2", "f_preds", sql="SELECT f.fold, round(1 - sum((p.y - f.m) * (p.y - f.m)) / regr_syy(p.y, p.y), 6) + 0e0 AS r2_null FROM f_preds p JOIN (SELECT a.fold, avg(b.y) AS m FROM (SELECT DISTINCT fold FROM f_preds) a JOIN f_preds b ON a.fold <> b.fold GROUP BY a.fold) f ON p.fold = f.fold GROUP BY f.fold")
def _(p):
    return rounded(agg.null_r2(p))


@query("A20_seed_summary", "f_runs", sql="SELECT config, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_sd, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd, count(*) AS n FROM f_runs GROUP BY config")
def _(r):
    return rounded(agg.seed_summary(r, ["config"], ["r2", "mae"], 1))


@query("A21_importance_summary", "f_importance", sql="SELECT feature, round(avg(importance), 6) AS importance FROM f_importance WHERE seed <= 4 GROUP BY feature")
def _(i):
    return rounded(agg.importance_summary(i)[0])


@query("A21_importance_shares", "f_importance", sql="WITH t AS (SELECT seed, CASE WHEN starts_with(feature, 'patch_') OR starts_with(feature, 'pca_') OR starts_with(feature, 'umap_') THEN 'Satellite (SSL)' WHEN feature IN ('latitude','longitude') THEN 'Coordinates' WHEN starts_with(feature, 'soil_') OR starts_with(feature, 'wc_class') OR contains(feature, 'wrb') THEN 'Soil / land cover' ELSE 'Climate' END AS category, sum(importance) AS x FROM f_importance WHERE seed <= 4 GROUP BY 1, 2), s AS (SELECT category, x / sum(x) OVER (PARTITION BY seed) AS share FROM t) SELECT category, round(avg(share), 6) AS share_mean, round(stddev_samp(share), 6) AS share_sd, count(*) AS n FROM s GROUP BY category")
def _(i):
    return rounded(agg.importance_summary(i, category=text.block_of(F.col("feature")))[1])


INTERVALS = "round(avg(CASE WHEN y BETWEEN least(lo, hi) AND greatest(lo, hi) THEN 1e0 ELSE 0e0 END), 6) AS coverage, round(avg(greatest(lo, hi) - least(lo, hi)), 6) AS mean_width, round(quantile_cont(greatest(lo, hi) - least(lo, hi), 0.5), 6) AS median_width, round(corr(greatest(lo, hi) - least(lo, hi), abs(yhat - y)), 6) + 0e0 AS width_error_corr, round(avg(greatest(0.05e0 * (y - least(lo, hi)), -0.95e0 * (y - least(lo, hi)))), 6) AS pinball_05, round(avg(greatest(0.5e0 * (y - yhat), -0.5e0 * (y - yhat))), 6) AS pinball_50, round(avg(greatest(0.95e0 * (y - greatest(lo, hi)), -0.05e0 * (y - greatest(lo, hi)))), 6) AS pinball_95, count(*) AS n"


@query("A22_interval_metrics", "f_preds", sql=f"SELECT config, {INTERVALS} FROM f_preds GROUP BY config")
def _(p):
    return rounded(agg.interval_metrics(p, ["config"]))


@query("A23_interval_by_stratum", "f_preds", sql=f"WITH e AS (SELECT quantile_cont(yhat, 0.25) AS a, quantile_cont(yhat, 0.5) AS b, quantile_cont(yhat, 0.75) AS c FROM f_preds) SELECT CASE WHEN yhat < a THEN 0 WHEN yhat < b THEN 1 WHEN yhat < c THEN 2 ELSE 3 END AS stratum, {INTERVALS} FROM f_preds, e GROUP BY 1 HAVING count(*) >= 10")
def _(p):
    return rounded(agg.interval_by_stratum(p))


FLAGGED = "o AS (SELECT *, abs(yhat - y) >= (SELECT quantile_cont(abs(yhat - y), 0.9) FROM f_preds) AS outlier FROM f_preds)"


@query("I10_flag_outliers", "f_preds", sql=f"WITH {FLAGGED} SELECT sample_k, outlier FROM o")
def _(p):
    return agg.flag_outliers(p).select("sample_k", "outlier")


@query("A28_group_enrichment", "f_preds", sql=f"WITH {FLAGGED} SELECT biome_name, count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(avg(CASE WHEN outlier THEN 1e0 ELSE 0e0 END), 6) AS outlier_rate, round(avg(CASE WHEN outlier THEN 1e0 ELSE 0e0 END) / (SELECT avg(CASE WHEN outlier THEN 1e0 ELSE 0e0 END) FROM o), 6) AS enrichment FROM o GROUP BY biome_name HAVING count(*) >= 50")
def _(p):
    return rounded(agg.group_enrichment(agg.flag_outliers(p), "biome_name"))


@query("A29_decile_profile", "f_preds", sql=f"WITH {FLAGGED}, e AS (SELECT DISTINCT unnest(quantile_cont(y, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS edge FROM f_preds), b AS (SELECT o.*, (SELECT count(*) FROM e WHERE e.edge < o.y) AS decile FROM o) SELECT CAST(decile AS INT) AS decile, count(*) AS n, round(avg(y), 6) AS mean_y, round(avg(CASE WHEN outlier THEN 1e0 ELSE 0e0 END), 6) AS outlier_rate, round(avg(y - yhat), 6) + 0e0 AS mean_residual FROM b GROUP BY decile")
def _(p):
    return rounded(agg.decile_profile(agg.flag_outliers(p)))


@query("A30_error_table", "f_preds", sql="SELECT sample_k, round(abs(yhat - y), 6) AS absolute_error, CASE WHEN y > 0 THEN round(100 * abs(yhat - y) / y, 4) END AS percent_error FROM f_preds")
def _(p):
    e = agg.error_table(p)
    return e.select("sample_k", F.round("absolute_error", 6).alias("absolute_error"), F.round("percent_error", 4).alias("percent_error"))


@query("A31_variance_table", "f_runs", sql="WITH r AS (SELECT run_seed AS k, sum(n) AS x FROM f_runs GROUP BY run_seed), c AS (SELECT k, sum(x * 1e0) OVER (ORDER BY k) / (SELECT sum(x) FROM r) AS c FROM r) SELECT min(k) FILTER (WHERE c >= 0.5) AS k_50, min(k) FILTER (WHERE c >= 0.8) AS k_80, min(k) FILTER (WHERE c >= 0.9) AS k_90, min(k) FILTER (WHERE c >= 0.95) AS k_95 FROM c")
def _(r):
    x = r.groupBy(F.col("run_seed").alias("k")).agg(F.sum("n").alias("x"))
    return agg.variance_table(x.crossJoin(x.agg(F.sum("x").alias("t"))).select("k", (F.col("x") / F.col("t")).alias("ratio")))


@query("A32_hist_density", "f_preds", sql="WITH e AS (SELECT min(y) AS a, max(y) AS b, count(y) AS c FROM f_preds) SELECT CAST(least(9, floor((y - a) / ((b - a) / 10))) AS INT) AS bin, count(*) AS n, round(count(*) / (any_value(c) * any_value((b - a) / 10)), 6) AS density FROM f_preds, e GROUP BY 1")
def _(p):
    return rounded(agg.hist_density(p, "y"))


@query("A32_kde_grid", "f_runs", sql="WITH e AS (SELECT min(r2) AS a, max(r2) AS b, count(r2) AS c, stddev_samp(r2) * pow(count(r2), -0.2) AS h FROM f_runs) SELECT round(a + i * (b - a) / 199, 6) AS x, round(sum(exp(-0.5e0 * pow((a + i * (b - a) / 199 - r2) / h, 2)) / (c * h * 2.5066282746310002e0)), 6) AS density FROM f_runs, e, range(200) t(i) GROUP BY i, a, b")
def _(r):
    return rounded(agg.kde_grid(r, "r2"))


@query("A26_location_stats", "f_samples", sql="SELECT count(*) AS n_locations, sum(n) AS n_samples, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share_colocated FROM (SELECT round(latitude, 6) AS a, round(longitude, 6) AS b, count(*) AS n FROM f_samples GROUP BY 1, 2)")
def _(s):
    return rounded(agg.location_stats(s))


@query("A37_mean_ci", "f_runs", sql="SELECT config, round(avg(r2), 6) AS mean, round(1.96e0 * stddev_pop(r2) / sqrt(count(r2)), 6) AS half, count(r2) AS n, round(avg(r2), 6) AS best FROM f_runs GROUP BY config")
def _(r):
    return rounded(agg.mean_ci(r, "r2"))


@query("F1_haversine", "f_samples", sql="SELECT sample_id, round(2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(latitude - 50) / 2), 2) + cos(radians(50e0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 10) / 2), 2))), 6) AS km FROM f_samples")
def _(s):
    return rounded(s.select("sample_id", geo.haversine_km(F.lit(50.0), F.lit(10.0), F.col("latitude"), F.col("longitude")).alias("km")))


@query("F3_block_id", "f_samples", sql="SELECT sample_id, CAST(floor(radians(longitude) * 6371008.8e0 * cos(radians(latitude)) / 25e0) AS BIGINT) AS bx, CAST(floor(radians(latitude) * 6371008.8e0 / 25e0) AS BIGINT) AS by_ FROM f_samples")
def _(s):
    b = geo.metric_block(F.col("latitude"), F.col("longitude"), 25.0)
    return s.select("sample_id", b["bx"].alias("bx"), b["by"].alias("by_"))


@query("F4_utm_zone", "f_samples", sql="SELECT sample_id, 32600 + least(60, CAST(floor((longitude + 180) / 6) AS INT) + 1) AS epsg FROM f_samples")
def _(s):
    return s.select("sample_id", geo.utm_epsg(F.col("latitude"), F.col("longitude")).alias("epsg"))


@query("F5_sanitize_id", "pages", sql="SELECT page_id, replace(replace(url, '/', '_'), chr(92), '_') AS safe FROM pages")
def _(p):
    return p.select("page_id", text.sanitize_id(F.col("url")).alias("safe"))


@query("F6_veg_indices", "f_obs", sql="SELECT seq, round(CASE WHEN abs(b8 + b4) > 1e-6 THEN (b8 - b4) / (b8 + b4) END, 6) + 0e0 AS ndvi, round(CASE WHEN abs(b8 + 6 * b4 - 7.5e0 * b2 + 1) > 1e-6 THEN 2.5e0 * (b8 - b4) / (b8 + 6 * b4 - 7.5e0 * b2 + 1) END, 6) + 0e0 AS evi, round((b3 - b8) / (b3 + b8), 6) + 0e0 AS ndwi, round((b8 - b12) / (b8 + b12), 6) + 0e0 AS nbr FROM f_obs")
def _(o):
    v = spectral.vegetation_indices(*[F.col(c) for c in ("b2", "b3", "b4", "b8", "b12")])
    return rounded(o.select("seq", *[c.alias(n) for n, c in v.items()]))


@query("F7_harmonize", "f_obs", sql="SELECT seq, CASE WHEN obs_date > DATE '2022-01-25' AND b8 >= 1000 THEN b8 - 1000 ELSE b8 END AS b8 FROM f_obs")
def _(o):
    return o.select("seq", spectral.harmonize(F.col("b8"), F.col("obs_date")).alias("b8"))


@query("F8_amp_to_db", "f_obs", sql="SELECT seq, CASE WHEN vv > 0 THEN CAST(trunc(least(32767e0, greatest(0e0, (20 * log10(vv) + 50) * 200))) AS INT) ELSE 0 END AS db FROM f_obs")
def _(o):
    return o.select("seq", spectral.amplitude_to_db(F.col("vv")).alias("db"))


VECTORS = """WITH v AS (SELECT sample_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_reverse(vec), lambda x: CAST(x AS DOUBLE)) AS b FROM f_patch),
d AS (SELECT sample_id, list_dot_product(a, a) AS aa, list_dot_product(a, b) AS ab, list_dot_product(b, b) AS bb FROM v)
SELECT sample_id, round(sqrt(aa), 5) AS l2, round(ab / sqrt(aa * bb), 5) + 0e0 AS cosine, round(sqrt(greatest(aa - 2 * ab + bb, 0)) / (sqrt(bb) + 1e-9), 5) AS relative_l2 FROM d"""


@query("F9_vector_functions", "f_patch", sql=VECTORS)
def _(p):
    a, b = F.col("vec"), F.reverse("vec")
    return rounded(p.select("sample_id", arrays.l2(a).alias("l2"), arrays.cosine(a, b).alias("cosine"), arrays.relative_l2(a, b).alias("relative_l2")), 5)


@query("F10_centre_crop", "f_patch", sql="SELECT sample_id, list_concat(list_concat(vec[21:24], vec[25:28]), list_concat(vec[37:40], vec[41:44])) AS crop FROM f_patch")
def _(p):
    return p.select("sample_id", arrays.centre_crop(F.col("vec"), 4, 2, 4).alias("crop"))


@query("F12_row_col", "f_samples", sql="SELECT sample_id, CAST(floor((60e0 - latitude) / 0.25e0) AS BIGINT) AS r, CAST(floor((longitude - 5e0) / 0.25e0) AS BIGINT) AS c FROM f_samples")
def _(s):
    return s.select("sample_id", geo.to_row(F.col("latitude"), 60.0, 0.25).alias("r"), geo.to_col(F.col("longitude"), 5.0, 0.25).alias("c"))


@query("F14_aoi_bbox", "f_samples", sql="SELECT continent, min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1 FROM f_samples GROUP BY continent")
def _(s):
    """The box of each continent's area, whose vertices are its samples' places."""
    x, y = F.col("longitude"), F.col("latitude")
    return s.groupBy("continent").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


@query("F15_names", "f_files", sql="SELECT stem, regexp_extract(stem, '^[^_]*_([^_]*)', 1) AS id FROM f_files")
def _(f):
    return f.select(text.stem(F.concat(F.lit("/a/b/"), "stem", F.lit(".npy"))).alias("stem"), F.split("stem", "_")[1].alias("id"))
