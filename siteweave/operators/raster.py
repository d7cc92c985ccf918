"""Rasters as pixel tables and pixel time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_quantiles


def class_mask(pixels: DataFrame, column: str, classes: list[int], at: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept pixels, percent masked by the keys at); a missing class is masked."""
    ok = F.coalesce(F.col(column).isin(*classes), F.lit(False))
    return pixels.where(ok), pixels.groupBy(*at).agg((100 * F.avg((~ok).cast("double"))).alias("percent_masked"))


def validate_tiles(pixels: DataFrame, keys: list[str], rows: int, value: str = "value", least_density: float = 0.0) -> DataFrame:
    """(keys, n, n_valid, ok): tiles of the expected size that are not all zero and dense enough."""
    g = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_valid"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    ok = (F.col("n") == rows) & ~((F.col("lo") == 0) & (F.col("hi") == 0)) & (F.col("n_valid") >= least_density * F.col("n"))
    return g.select(*keys, "n", "n_valid", F.coalesce(ok, F.lit(False)).alias("ok"))


def sample_grid(points: DataFrame, pixels: DataFrame, top: float, left: float, size: float, nodata: float | None = None, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Points with the value of the raster cell they lie in; null outside the raster or on nodata."""
    at = points.withColumns({"row_i": F.floor((F.lit(top) - F.col(lat)) / size), "col_i": F.floor((F.col(lon) - F.lit(left)) / size)})
    value = F.col("value") if nodata is None else F.nullif(F.col("value"), F.lit(nodata))
    return at.join(pixels.select("row_i", "col_i", value.alias("value")), ["row_i", "col_i"], "left").select(*points.columns, "value")


def temporal_stats(obs: DataFrame, keys: list[str], bands: list[str], clear: Column) -> DataFrame:
    """Mean, median, p10, p90 and population deviation of the clear observations of each pixel and band."""
    aggs = []
    for b in bands:
        v = F.when(clear, F.col(b)).cast("double")
        q = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        aggs += [F.avg(v).alias(f"{b}_mean"), q.alias(f"__{b}"), F.stddev_pop(v).alias(f"{b}_sd")]
    out = obs.groupBy(*keys).agg(*aggs)
    for b in bands:
        out = out.withColumns({f"{b}_p10": F.col(f"__{b}")[0], f"{b}_median": F.col(f"__{b}")[1], f"{b}_p90": F.col(f"__{b}")[2]}).drop(f"__{b}")
    return out


def index_stats(obs: DataFrame, keys: list[str], indices: dict[str, Column], clear: Column) -> DataFrame:
    """temporal_stats() of index columns, and their amplitude p90 - p10."""
    named = obs.select(*keys, clear.alias("__clear"), *[c.alias(n) for n, c in indices.items()])
    out = temporal_stats(named, keys, list(indices), F.col("__clear"))
    return out.withColumns({f"{n}_amplitude": F.col(f"{n}_p90") - F.col(f"{n}_p10") for n in indices})


def phenology(obs: DataFrame, keys: list[str], value: Column, doy: str = "doy", order: str = "seq") -> DataFrame:
    """Day of the greatest and the least value (the first of equals), sum, and mean step between neighbouring valid values.

    A masked (null) observation parts its neighbours. A pixel without values has sum 0 and no days.
    """
    before = F.lag("__v").over(Window.partitionBy(*keys).orderBy("__o"))
    v = obs.select(*keys, F.col(order).alias("__o"), F.col(doy).alias("__d"), value.alias("__v")).withColumn("__step", F.abs(F.col("__v") - before))
    day = lambda f, sign: f("__d", F.when(F.col("__v").isNotNull(), F.struct("__v", (sign * F.col("__o")).alias("o"))))
    return v.groupBy(*keys).agg(day(F.max_by, -1).alias("doy_max"), day(F.min_by, 1).alias("doy_min"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("integral"), F.avg("__step").alias("roughness"))


def sar_stats(obs: DataFrame, keys: list[str], orbits: tuple[str, ...] = ("ascending", "descending")) -> DataFrame:
    """Mean, median and population deviation of vv and vh by orbit; rows with both 0 are no data."""
    ok = ~((F.col("vv") == 0) & (F.col("vh") == 0))
    aggs = []
    for o in orbits:
        for p in ("vv", "vh"):
            v = F.when(ok & (F.col("orbit") == o), F.col(p))
            aggs += [F.avg(v).alias(f"{p}_{o}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{p}_{o}_median"), F.stddev_pop(v).alias(f"{p}_{o}_sd")]
    return obs.groupBy(*keys).agg(*aggs)


def mosaic_first_valid(pixels: DataFrame, keys: list[str], bands: list[str], priority: str, valid: Column, fill: float = 0.0) -> DataFrame:
    """All bands of each key from its first valid source, else fill."""
    pick = F.min_by(F.when(valid, F.struct(*bands)), F.when(valid, F.col(priority)))
    return pixels.groupBy(*keys).agg(pick.alias("__b")).select(*keys, *[F.coalesce(F.col("__b")[b].cast("double"), F.lit(fill)).alias(b) for b in bands])


def mosaic_first_nonzero(pixels: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    v = F.when(F.col(value) != 0, F.col(value))
    return pixels.groupBy(*keys).agg(F.coalesce(F.min_by(v, F.when(v.isNotNull(), F.col(priority))), F.lit(0.0)).alias(value))


def coverage(pixels: DataFrame, keys: list[str], valid: Column, least: float) -> DataFrame:
    """Percent of valid pixels of each key, where it reaches least."""
    return pixels.groupBy(*keys).agg((100 * F.avg(valid.cast("double"))).alias("percent"), F.count(F.lit(1)).alias("n")).where(F.col("percent") >= least)


def band_coverage(pixels: DataFrame, keys: list[str], bands: list[str], least: float) -> DataFrame:
    """(keys, n, <band>_percent, <band>_kept): items of which any band has values above 0 on least percent of the pixels; a band is kept only if its own do. Nulls and NaN are no values."""
    ok = {b: F.coalesce((F.col(b) > 0) & ~F.isnan(F.col(b).cast("double")) & (F.col(b) < float("inf")), F.lit(False)) for b in bands}
    got = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(100 * F.avg(v.cast("double"))).alias(f"{b}_percent") for b, v in ok.items()])
    return got.withColumns({f"{b}_kept": F.col(f"{b}_percent") >= least for b in bands}).where(F.greatest(*[F.col(f"{b}_percent") for b in bands]) >= least)


def covered_bands(bands: DataFrame, quality: DataFrame, date: str, valid: Column, least: float) -> DataFrame:
    """Rows of bands on the dates whose coverage in quality reaches least.

    quality decides first. If bands is a table partitioned by date, only the partitions of those
    dates are read (dynamic partition pruning).
    """
    return bands.join(coverage(quality, [date], valid, least).select(date), date, "left_semi")


def map_summary(maps: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, quartiles, least, greatest and number of the values of each map."""
    got = maps.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    return with_quantiles(got, maps, keys, value, {"q25": 0.25, "q75": 0.75})


def group_scenes(scenes: DataFrame, by_orbit: bool = False, box: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Scenes of each day (and orbit, a missing one as unknown), with the box around their boxes (west, south, east, north) if the columns are named."""
    around = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), box or (), strict=False)]
    keys = [F.to_date("dt").alias("day")] + ([F.coalesce("orbit", F.lit("unknown")).alias("orbit")] if by_orbit else [])
    return scenes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"), *around)


def windows(pixels: DataFrame, size: int, keys: list[str], value: str = "value", complete: bool = True) -> DataFrame:
    """Each pixel's size x size neighbourhood as an array in row order.

    Every pixel is sent to the centres it belongs to and gathered there: one shuffle and no self
    join. With complete only centres with all neighbours valid stay; else missing ones are null.
    """
    h = size // 2
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-h, h + 1) for c in range(-h, h + 1)])
    sent = pixels.select(*keys, "row_i", "col_i", value).withColumn("d", F.explode(steps))
    at = ((F.lit(h) - F.col("d.r")) * size + (h - F.col("d.c"))).cast("int")
    sent = sent.select(*keys, (F.col("row_i") + F.col("d.r")).alias("row_i"), (F.col("col_i") + F.col("d.c")).alias("col_i"), at.alias("at"), F.col(value).alias("v"), ((F.col("d.r") == 0) & (F.col("d.c") == 0)).alias("own"))
    g = sent.groupBy(*keys, "row_i", "col_i").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"), F.count("v").alias("n"), F.max("own").alias("own"))
    g = g.where(F.col("own") & ((F.col("n") == size * size) if complete else F.lit(True)))
    return g.select(*keys, "row_i", "col_i", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i)).alias("patch"))


def extract_patches(points: DataFrame, pixels: DataFrame, size: int, key: str, edge: str = "neighbors", fill: float = 0.0, tile: str = "tile") -> DataFrame:
    """A size x size patch around each point (key, row_i, col_i, tile) from pixels with global rows and columns.

    neighbors: cells of other tiles fill what the point's own lacks, its own first, and a patch with a
    missing cell is dropped; pad: own tile alone, other cells are fill; mosaic: all tiles, other
    cells are fill. A point whose own cell is missing has no patch.
    """
    h = size // 2
    steps = F.array(*[F.struct(F.lit(i * size + j).alias("at"), F.lit(i - h).alias("r"), F.lit(j - h).alias("c")) for i in range(size) for j in range(size)])
    want = points.select(key, F.col(tile).alias("__t"), "row_i", "col_i").withColumn("d", F.explode(steps)).select(key, "__t", F.col("d.at").alias("at"), (F.col("row_i") + F.col("d.r")).alias("row_i"), (F.col("col_i") + F.col("d.c")).alias("col_i"))
    own = F.col("__t") == F.col(tile)
    got = want.join(pixels.select("row_i", "col_i", tile, "value"), ["row_i", "col_i"], "left")
    v = F.when(own, F.col("value")) if edge == "pad" else F.col("value")
    one = got.groupBy(key, "at").agg(F.min_by(v, F.when(v.isNotNull(), F.struct((~own).alias("o"), F.col(tile).alias("t")))).alias("v"))
    g = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"), F.count("v").alias("n"))
    g = g.where(F.try_element_at("m", F.lit(size * size // 2)).isNotNull())
    if edge == "neighbors":
        g = g.where(F.col("n") == size * size)
    return g.select(key, F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(fill))).alias("patch"))


def regrid(pixels: DataFrame, rows: int, cols: int, scale: float, how: str = "nearest", value: str = "value") -> DataFrame:
    """A raster on a grid whose cells are scale source cells wide; cell centres map to centres.

    nearest takes the source cell that holds the centre; bilinear weighs the four around it, over
    those that have a value.
    """
    spark = pixels.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("r")).crossJoin(spark.range(cols).select(F.col("id").alias("c")))  # the target grid itself
    y, x = (F.col("r") + 0.5) * scale, (F.col("c") + 0.5) * scale
    src = pixels.select("row_i", "col_i", F.col(value).alias("v"))
    if how == "nearest":
        return grid.withColumns({"row_i": F.floor(y), "col_i": F.floor(x)}).join(src, ["row_i", "col_i"], "left").select("r", "c", F.col("v").alias(value))
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    g = grid.withColumns({"y0": F.floor(y - 0.5), "x0": F.floor(x - 0.5), "fy": y - 0.5 - F.floor(y - 0.5), "fx": x - 0.5 - F.floor(x - 0.5)}).withColumn("k", F.explode(corner))
    w = F.when(F.col("k.i") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.j") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    g = g.select("r", "c", w.alias("w"), (F.col("y0") + F.col("k.i")).alias("row_i"), (F.col("x0") + F.col("k.j")).alias("col_i")).join(src, ["row_i", "col_i"], "left")
    ok = F.when(F.col("v").isNotNull(), F.col("w"))
    return g.groupBy("r", "c").agg(F.try_divide(F.sum(ok * F.col("v")), F.nullif(F.sum(ok), F.lit(0.0))).alias(value))


def slope_aspect(pixels: DataFrame, keys: list[str], size: float = 1.0) -> DataFrame:
    """Rise over run and aspect in degrees from a complete 3 x 3 window (Horn)."""
    p = lambda i: F.col("patch")[i]
    dx = ((p(2) + 2 * p(5) + p(8)) - (p(0) + 2 * p(3) + p(6))) / (8 * size)
    dy = ((p(6) + 2 * p(7) + p(8)) - (p(0) + 2 * p(1) + p(2))) / (8 * size)
    return windows(pixels, 3, keys).select(*keys, "row_i", "col_i", F.sqrt(dx * dx + dy * dy).alias("slope"), F.degrees(F.atan2(dy, -dx)).alias("aspect"))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0 to 1; a constant column becomes null."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__b_{c}") - F.col(f"__a_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns)  # one row


def impute_channels(patches: DataFrame, patch: str, c: int) -> DataFrame:
    """patches (arrays of cells with c channels each) with null and NaN values as their channel's mean in the patch; 0 in a channel without any."""
    known = lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
    own = lambda k: F.filter(F.filter(patch, lambda v, i: i % c == k), known)
    mean = lambda k: F.coalesce(F.try_divide(F.aggregate(own(k), F.lit(0.0), lambda s, v: s + v.cast("double")), F.size(own(k))), F.lit(0.0))
    filled = patches.withColumn("__means", F.transform(F.sequence(F.lit(0), F.lit(c - 1)), mean))
    return filled.withColumn(patch, F.transform(patch, lambda v, i: F.when(known(v), v.cast("double")).otherwise(F.get("__means", i % c)))).drop("__means")
