"""Fold assignment, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import metric_block
from ..functions.hashing import portable_hash, uniform
from .components import connected_components
from .joins import within_radius
from .ranking import numbered_within
from .skew import hub_join


def random_folds(df: DataFrame, k: int, seed: int, key: str = "k") -> DataFrame:
    return df.withColumn("fold", F.pmod(portable_hash(F.col(key), seed), F.lit(k)).cast("int"))


def deal_equal(loads: list[int], size: int, count: int) -> tuple[list[int], list[list[int]], list[int]]:
    """(starts, orders, loads after) of dealing `count` groups of one size, each to the fold with the least load, the first of equals.

    The loads at which a fold takes a group are its own, and that plus 1, 2, ... times the size; the
    groups take them in order. In a window as wide as the size every fold whose load is not beyond it
    takes one, always in the same order, so group number t from starts[i] on goes to
    orders[i][(t - starts[i]) % len(orders[i])]: at most one run for each fold, whatever the count.
    """
    least = min(loads)
    window = [(x - least) // size for x in loads]
    starts, orders, t = [], [], 0
    steps = sorted(set(window))
    for w, after in zip(steps, [*steps[1:], None], strict=True):
        order = sorted((f for f in range(len(loads)) if window[f] <= w), key=lambda f: ((loads[f] - least) % size, f))
        starts.append(t)
        orders.append(order)
        if after is None or (t := t + (after - w) * len(order)) >= count:
            break
    out = list(loads)
    for first, last, order in zip(starts, [*starts[1:], count], orders, strict=True):
        rounds, more = divmod(last - first, len(order))
        for i, f in enumerate(order):
            out[f] += size * (rounds + (i < more))
    return starts, orders, out


def pack_groups(sizes: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, fold): groups by size, largest first and equal sizes shuffled, each to the fold with the least load, the first of equals.

    sizes has (group, n), group a number, n at least 1. Loads differ by the largest size at most.
    Where a group goes depends on its size and on its place among those of the same size alone
    (deal_equal), so the driver deals sizes, not groups: n rows have fewer than sqrt(2 n) different
    sizes. The groups are numbered within their size by ranges, and a size that many groups have is joined
    where they lie. One rule at every size; empty input gives no rows.
    """
    spark = sizes.sparkSession
    sizes = sizes.select(group, F.col("n").cast("long").alias("__size"), portable_hash(F.col(group), seed).alias("__h"))
    counts = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("__size")).collect()
    loads, rows = [0] * k, []
    for r in counts:
        starts, orders, loads = deal_equal(loads, r["__size"], r["n"])
        rows.append((r["__size"], r["n"], starts, orders))
    dealt = spark.createDataFrame(rows, "__size long, n long, __starts array<long>, __orders array<array<int>>")
    placed = numbered_within(sizes, "__size", [F.col("__h"), F.col(group)], "__t")
    joined = hub_join(placed, dealt, "__size", sum(r["n"] for r in counts))
    run = F.size(F.filter("__starts", lambda x: x <= F.col("__t")))
    order, start = F.element_at("__orders", run), F.element_at("__starts", run)
    return joined.select(group, F.element_at(order, (F.pmod(F.col("__t") - start, F.size(order)) + 1).cast("int")).alias("fold"))


def both_sides(df: DataFrame, fold: str = "fold") -> DataFrame:
    """df without the rows of folds whose complement is empty: one fold that has all rows has nothing to train on."""
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("__n"))  # a row for each fold
    all_rows = sizes.agg(F.sum("__n").alias("__all"))
    usable = sizes.crossJoin(F.broadcast(all_rows)).where("__n < __all").select(fold)
    return df.join(F.broadcast(usable), fold, "left_semi")


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """df with fold: the rows of a group share one, folds are as even as pack_groups() makes them, and one without a row to train on is left out."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return both_sides(df.join(pack_groups(sizes, group, k, seed), group))


def place_number(lat: str, lon: str, decimals: int) -> Column:
    """One number for each place, of coordinates rounded to at most 7 decimals; null if either is."""
    part = lambda c, most: F.round((F.round(c, decimals) + most) * 10**decimals).cast("long")
    return part(lat, 90) * (1 << 32) + part(lon, 180)


def _numbered(df: DataFrame, name: str, parts: list[Column]) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*parts), F.lit(1 << 52)))


def location_folds(df: DataFrame, k: int, seed: int, decimals: int = 6) -> DataFrame:
    """Rows of one place (coordinates rounded) share a fold; rows without a place share one as well."""
    at = df.withColumn("group", F.coalesce(place_number("latitude", "longitude", decimals), F.lit(-1).cast("long")))
    return group_folds(at, "group", k, seed)


def distance_groups(df: DataFrame, link_m: float, decimals: int = 7) -> DataFrame:
    """df with group: places that links of at most link_m join, of the smallest place number each."""
    at = df.withColumns({"__la": F.round("latitude", decimals), "__lo": F.round("longitude", decimals), "place": place_number("latitude", "longitude", decimals)})
    places = at.groupBy("place").agg(F.first("__la").alias("lat"), F.first("__lo").alias("lon"))
    if link_m <= 0:
        return at.withColumn("group", F.col("place")).drop("__la", "__lo", "place")
    links = within_radius(places, places, link_m / 1000, "place").where("a < b")
    comp = connected_components(links)
    return at.join(comp, at["place"] == comp["node"], "left").withColumn("group", F.coalesce("component", "place")).drop("__la", "__lo", "place", "node", "component")


def block_folds(df: DataFrame, metres: float, k: int, seed: int) -> DataFrame:
    """Rows of one square of a local metric grid share a fold; rows without a place share one as well. metres is 0.02 or more."""
    at = metric_block(F.col("latitude"), F.col("longitude"), metres)
    number = (at["bx"] + (1 << 30)) * (1 << 31) + at["by"] + (1 << 30)
    return group_folds(df.withColumn("group", F.coalesce(number, F.lit(-1).cast("long"))), "group", k, seed)


def split3(df: DataFrame, seed: int, key: str = "k") -> DataFrame:
    """A fifth for testing, an eighth of the rest for validation."""
    u = uniform(F.col(key), seed)
    return df.withColumn("split", F.when(u < 0.2, "test").when(u < 0.3, "validation").otherwise("train"))


def split_within(df: DataFrame, domain: str, seed: int, share: float = 0.2, key: str = "k") -> DataFrame:
    """The same share of each domain for testing: the rows of smallest hash. No task sorts a whole domain."""
    columns = [c for c in df.columns if c != "split"]
    dealt = numbered_within(df, domain, [portable_hash(F.col(key), seed), F.col(key)], "__r")
    sizes = df.groupBy(F.col(domain).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    placed = dealt.join(sizes, F.col(domain).eqNullSafe(F.col("__d")))
    return placed.select(*columns, F.when(F.col("__r") < F.round(share * F.col("__n")), "test").otherwise("train").alias("split"))


def stratified_sample(df: DataFrame, stratum: str, share: float, seed: int, key: str = "k") -> DataFrame:
    """round(share * n) rows of each stratum."""
    return split_within(df, stratum, seed, share, key).where("split = 'test'").drop("split")


def sample_manifest(tables: dict[str, DataFrame], ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """(table, kept): the rows of each table that the sampled ids keep."""
    from functools import reduce

    parts = [t.join(ids.select(key), key, "left_semi").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("kept")) for n, t in tables.items()]
    return reduce(lambda a, b: a.union(b), parts)


def apply_buffer(df: DataFrame, fold: int, km: float, least: int = 10, key: str = "id") -> DataFrame:
    """The training rows of a fold that are further than km from its test rows; none if fewer than least."""
    train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
    near = within_radius(train, test, km, key).select(F.col("a").alias(key)).distinct()
    kept = train.join(near, key, "left_anti")
    enough = kept.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return kept.crossJoin(F.broadcast(enough)).drop("__n")  # one row or none


#: Fold schemes by name.
SCHEMES = {
    "random": random_folds,
    "location": lambda df, k, seed: location_folds(df, k, seed),
    "linked_25m": lambda df, k, seed: group_folds(_numbered(distance_groups(df, 25.0), "group", [F.lit(seed), F.col("group")]), "group", k, seed),
    "block_25m": lambda df, k, seed: block_folds(df, 25.0, k, seed),
    "block_50m": lambda df, k, seed: block_folds(df, 50.0, k, seed),
}
