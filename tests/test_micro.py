"""Edge cases by hand."""

import numpy as np
from pyspark.sql import functions as F

from siteweave.functions import spectral
from siteweave.operators import joins, ranking, raster
from siteweave.operators.components import connected_components
from siteweave.sources import files, samples


def test_phenology_masks_ties_and_empty(spark):
    rows = [(1, 1, 10, 0.2), (1, 2, 20, None), (1, 3, 30, 0.8), (1, 4, 40, 0.5), (2, 1, 5, 0.4), (2, 2, 6, 0.7), (2, 3, 7, 0.7), (3, 1, 9, None)]
    df = spark.createDataFrame(rows, "pixel int, seq int, doy int, v double")
    got = {r["pixel"]: r for r in raster.phenology(df, ["pixel"], F.col("v")).collect()}
    assert abs(got[1]["integral"] - 1.5) < 1e-9 and abs(got[1]["roughness"] - 0.3) < 1e-9
    assert got[2]["doy_max"] == 6
    assert got[3]["integral"] == 0 and got[3]["doy_max"] is None and got[3]["roughness"] is None


def test_antimeridian_and_pole(spark):
    df = spark.createDataFrame([(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 89.999, 10.0), (4, 89.999, -170.0)], "id int, lat double, lon double")
    got = {(r["a"], r["b"]) for r in joins.within_radius(df, df, 5.0).where("a < b").collect()}
    assert got == {(1, 2), (3, 4)}


def test_bh_and_capture(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r["p"]: r["q"] for r in ranking.bh_fdr(df, "p").collect()}
    assert {k: v and round(v, 6) for k, v in got.items()} == {0.01: 0.03, 0.04: 0.04, 0.03: 0.04, None: None}
    five = spark.createDataFrame([(float(i), 1.0) for i in range(5)], "s double, e double")
    assert ranking.capture_curve(five, "s", "e", (0.1,)).first()["m"] == 1


def test_conversions(spark):
    df = spark.createDataFrame([("2022-01-25", 1500, 1.0), ("2022-01-26", 1500, 0.0), ("2022-01-26", 900, None)], "d string, dn int, a double")
    got = df.select(spectral.harmonize(F.col("dn"), F.to_date("d")).alias("dn"), spectral.amplitude_to_db(F.col("a")).alias("db")).collect()
    assert [r["dn"] for r in got] == [1500, 500, 900] and [r["db"] for r in got] == [10000, 0, 0]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patch_files_and_samples(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(18, dtype=np.float32).reshape(3, 3, 2))
    np.save(tmp_path / "b.npy", np.full((3, 3, 2), np.nan))
    (tmp_path / "c.npy").write_bytes(b"junk")
    kept, skipped = files.ingest_patches(spark, str(tmp_path))
    assert [(r["sample_id"], r["p"], r["c"], len(r["patch"])) for r in kept.collect()] == [("a", 3, 2, 18)]
    assert {r["id"] for r in skipped.collect()} == {"b", "c"}
    csv = tmp_path / "s.csv"
    csv.write_text("sample_id,latitude,longitude,rarefied\n1,2.0,3.0,4.0\n1,2.0,3.0,9.0\n2,,3.0,4.0\n")
    assert [r["rarefied"] for r in samples.load_samples(spark, [str(csv)]).collect()] == [4.0]
    files.write_bundle(str(tmp_path / "out"), "x", {"t": kept.select("sample_id")})
    assert [(r["bundle"], r["table"]) for r in files.list_bundles(spark, str(tmp_path / "out")).collect()] == [("x", "t")]


def test_components_of_chains_and_hubs_in_few_jobs(spark):
    """A chain, a star whose centre is its largest node and one whose centre is its smallest, with held nodes few; each round's plan holds no other."""
    import random

    from siteweave.operators import components

    chain = [(i, i + 1) for i in range(1, 400)]
    top = [(9000, i) for i in range(1000, 3000)]
    low = [(10000, i) for i in range(10001, 11000)] + [(10000, 9000)]
    edges = chain + top + low + [(5, 5), (None, 3), (2, 1)]
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    small = components.contracted(df.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v"), 16)
    for given, x, y in ((df, "a", "b"), (small, "u", "v")):
        found = connected_components(given, x, y)
        got = {r["node"]: r["component"] for r in found.collect()}
        want = {i: 1 for i in range(1, 401)} | {i: 1000 for i in [*range(1000, 3000), 9000, *range(10000, 11000)]}
        assert got == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # the labels are read as they are stored
    assert max(components.contracted(df.selectExpr("a AS u", "b AS v").where("u > v")).groupBy("u").count().toPandas()["count"]) <= 5
