"""Views over the shared tables that give every operator an input of its shape, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "f_samples": """
SELECT CAST(s.c_custkey AS STRING) AS sample_id, s.c_custkey AS k, s.site, s.cell,
       4.5e1 + ((s.cell * 37) % 201) * 7.5e-2
         + CASE s.site % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1.5e-4 ELSE 3.3e-4 END AS latitude,
       5e0 + ((s.cell * 53) % 201) * 1e-1 AS longitude,
       s.c_acctbal AS rarefied, s.c_mktsegment AS biome_name, r.r_name AS continent
FROM (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, (c_custkey * 7) % 601 AS site,
             CAST(floor(((c_custkey * 7) % 601) / 3e0) AS BIGINT) AS cell FROM customer) s
JOIN nation n ON s.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "f_patch": """
SELECT CAST(c.c_custkey AS STRING) AS sample_id, e.embedding AS vec
FROM customer c CROSS JOIN (SELECT count(*) AS n FROM embeddings) t JOIN embeddings e ON e.vec_id = c.c_custkey % t.n
WHERE c.c_custkey % 13 <> 5
""",
    "f_climate_monthly": """
SELECT CAST(c.c_custkey AS STRING) AS sample_id, v.var, m.month,
       CASE WHEN (c.c_custkey + m.month) % 17 = 0 THEN NULL
            WHEN v.var = 'tavg' AND c.c_custkey % 19 = 0 THEN NULL
            ELSE ((c.c_custkey * 13 + m.month * 29 + v.vk * 7) % 400) / 4e0 END AS value
FROM customer c
CROSS JOIN (VALUES ('prec', 1), ('tavg', 2), ('wind', 3)) AS v(var, vk)
CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS m(month)
""",
    "f_soil_raw": """
SELECT CAST(c.c_custkey AS STRING) AS sample_id, v.var, v.depth,
       CASE WHEN (c.c_custkey + v.dk) % 23 = 0 THEN NULL
            WHEN v.var = 'wrb' THEN (c.c_custkey % 5) * 1e0
            ELSE ((c.c_custkey * 31 + v.vk * 17 + v.dk * 7) % 500) * 1e0 END AS raw
FROM customer c
CROSS JOIN (VALUES ('phh2o','0_5cm',1,0), ('phh2o','5_15cm',1,1), ('nitrogen','0_5cm',2,0),
                   ('nitrogen','5_15cm',2,1), ('clay','0_5cm',3,0), ('clay','5_15cm',3,1),
                   ('wrb','all',4,2)) AS v(var, depth, vk, dk)
WHERE c.c_custkey % 29 <> 0
""",
    "f_landcover": """
SELECT CAST(c.c_custkey AS STRING) AS sample_id, d.seq,
       CASE (c.c_custkey + d.seq) % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40
            WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 80 ELSE 90 END AS land_cover_class
FROM customer c CROSS JOIN (VALUES (0), (1)) AS d(seq)
WHERE c.c_custkey % 11 <> 0 AND (d.seq = 0 OR c.c_custkey % 37 = 1)
""",
    "f_obs": """
SELECT user_id AS pixel, event_id AS seq, ts, CAST(dayofyear(ts) AS INT) AS doy, CAST(ts AS DATE) AS obs_date,
       CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 6 WHEN 'click' THEN 4
            WHEN 'view' THEN 5 ELSE 3 END AS scl,
       event_id % 3 AS tile_idx,
       2e2 + (event_id * 37) % 900 AS b2, 3e2 + (event_id * 53) % 1100 AS b3,
       2.5e2 + (event_id * 71) % 1200 AS b4, 9e2 + (event_id * 91) % 3100 AS b8,
       4e2 + (event_id * 29) % 1500 AS b12,
       CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE value END AS vv,
       CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE value / 4e0 END AS vh,
       CASE event_id % 2 WHEN 0 THEN 'ascending' ELSE 'descending' END AS orbit
FROM events
""",
    "f_scenes": """
SELECT event_id AS item_id, ts AS dt, (event_id * 17) % 100 * 1e0 AS cloud,
       CASE event_id % 2 WHEN 0 THEN 'ascending' ELSE 'descending' END AS orbit
FROM events
""",
    "f_pixels": """
SELECT CAST(floor(e.vec_id / 25e0) AS BIGINT) AS row_i, e.vec_id % 25 AS col_i,
       CASE WHEN e.vec_id % 25 < 13 THEN 0 ELSE 1 END AS tile, y.yr,
       CASE WHEN e.vec_id = 79 THEN NULL ELSE (e.vec_id * 37 % 251 + y.shift * (e.vec_id % 7)) * 1e0 END AS value,
       CASE (e.vec_id * 3) % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 50 WHEN 3 THEN 80
            WHEN 4 THEN 30 WHEN 5 THEN 40 WHEN 6 THEN 60 ELSE 90 END AS land_cover_class
FROM embeddings e CROSS JOIN (VALUES (2017, 0), (2024, 1)) AS y(yr, shift)
""",
    "f_poly_vertices": """
SELECT poly_id, name, vi, x, y FROM (VALUES
  (1,'A',0,5e0,45e0),(1,'A',1,12e0,45e0),(1,'A',2,12e0,52e0),(1,'A',3,5e0,52e0),
  (2,'B',0,10e0,50e0),(2,'B',1,18e0,50e0),(2,'B',2,18e0,58e0),(2,'B',3,10e0,58e0),
  (3,'C',0,18e0,45e0),(3,'C',1,25e0,45e0),(3,'C',2,25e0,60e0),(3,'C',3,22e0,60e0),
  (3,'C',4,22e0,48e0),(3,'C',5,18e0,48e0)) AS p(poly_id, name, vi, x, y)
""",
    "f_registry": """
SELECT y.yr AS year, p_partkey % 200 * 10 + 505 AS lon_i, CAST(floor(p_partkey / 2e2) AS BIGINT) * 20 + 4505 AS lat_i
FROM part CROSS JOIN (VALUES (2022), (2023), (2024)) AS y(yr)
""",
    "f_preds": """
SELECT o_orderkey AS sample_k, o_orderpriority AS config, o_orderkey % 5 + 1 AS seed, o_orderkey % 4 AS fold,
       o_orderstatus AS biome_name, o_totalprice / 1e3 AS y,
       o_totalprice / 1e3 * 7e-1 + (o_orderkey * 7919) % 1000 / 1e1 AS yhat,
       o_totalprice / 1e3 * 7e-1 + (o_orderkey * 7919) % 1000 / 1e1 - (20 + o_orderkey % 90) AS lo,
       o_totalprice / 1e3 * 7e-1 + (o_orderkey * 7919) % 1000 / 1e1 + (20 + o_orderkey % 70) AS hi,
       (o_orderkey * 31) % 17 * 1e0 AS tied_covariate
FROM orders
""",
    "f_runs": """
SELECT concat(l_returnflag, '_', l_linestatus) AS config, l_linenumber AS run_seed,
       avg(l_discount) * 1e1 AS r2, avg(l_extendedprice) / 1e3 AS rmse, avg(l_quantity) AS mae, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber
""",
    "f_importance": """
SELECT s.seed,
       CASE WHEN p_partkey = 7 THEN 'elev' WHEN p_partkey = 8 THEN 'latitude' ELSE CASE p_partkey % 9 WHEN 0 THEN concat('patch_', CAST(p_partkey AS STRING))
            WHEN 1 THEN concat('pca_', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('soil_v', CAST(p_partkey AS STRING))
            WHEN 3 THEN concat('wrb_class_', CAST(p_partkey AS STRING)) WHEN 4 THEN concat('bio_', CAST(p_partkey AS STRING))
            WHEN 5 THEN concat('prec_annual_', CAST(p_partkey AS STRING)) WHEN 6 THEN concat('wc_class_', CAST(p_partkey AS STRING))
            WHEN 7 THEN concat('umap_', CAST(p_partkey AS STRING)) ELSE concat('other_', CAST(p_partkey AS STRING)) END END AS feature,
       ((p_partkey * 31 + s.seed * 17) % 1000) / 1e3 AS importance
FROM part CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS s(seed)
WHERE s.seed < 5 OR p_partkey % 6 <> 0
""",
    "f_files": """
SELECT concat('2021_S', CAST(c.c_custkey AS STRING), '_', d.suffix) AS stem
FROM customer c CROSS JOIN (VALUES ('rarefied', 0), ('rerun', 1)) AS d(suffix, j)
WHERE d.j = 0 OR c.c_custkey % 41 = 2
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a shared table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    used = sorted(set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", VIEWS[name])) & set(TABLES))
    sql = re.sub(r"((?:FROM|JOIN)\s+)(\w+)", lambda m: f"{m[1]}{{{m[2]}}}" if m[2] in used else m[0], VIEWS[name])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used}) if used else spark.sql(sql)


def with_views(sql: str) -> str:
    """sql with the views that it names as common table expressions in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}"
    return f"WITH {head}, {body[4:].strip()}" if re.match(r"WITH\b", body) else f"WITH {head} {body}"
