"""Quantiles by key: mergeable sketches, and exact values that sketches narrow down, without a task that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import ranking
from .skew import hub_join

#: Size parameter of a sketch, between 8 and 65,535. It has a few times as many values.
SKETCH_SIZE = 1024
#: Rows of a group up to which Spark's exact percentile, which holds a group's values in one task, is as good.
GROUP_ROWS = 1 << 20


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The rank error of a KLL sketch as a share of the rows, 99 times of 100 (the published fit for two-sided bounds)."""
    return 2.446 / size**0.9433


def _known(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """(__k, __v): keys as one struct, and the value as a double that is neither null nor NaN."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__")).alias("__k"), v.alias("__v"))
    return rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))


def _keys(found: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return found.select(*[F.col("__k")[k].alias(k) for k in keys], *more)


def sketches(df: DataFrame, keys: list[str], value: Column | str, size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, sketch, n): a mergeable KLL sketch of each key's values; tasks sketch their own rows, and only sketches are shuffled.

    Nulls and NaN take no part; a key without values has no row.
    """
    got = _known(df, keys, value).groupBy("__k").agg(F.kll_sketch_agg_double("__v", F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    return _keys(got, keys, "sketch", "n")


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys (a subset) from those of more, as from earlier days or partitions."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def from_sketches(parts: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, q, n): approximate quantiles, each a value whose rank is within rank_error() of the one asked for."""
    return parts.select(*keys, F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in qs]).alias("q"), "n")


def selected(df: DataFrame, keys: list[str], value: Column | str, qs: list[float], size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, q): exact quantiles with linear interpolation.

    A sketch of each key says between which two values a quantile lies. Values below are only
    counted; those between, about 4 rank errors of the rows, are counted by value, dealt by ranges and given
    their ranks. Rows of a key that many rows have are compared with its bounds where they lie. A
    quantile that a sketch has missed (rarely) is found by ranking all values of its key.
    """
    rows = _known(df, keys, value)
    e = 2 * rank_error(size)
    q_of = lambda q: F.lit(None).cast("double") if not 0 < q < 1 else F.kll_sketch_get_quantile_double("__s", F.lit(q))
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    bounds = [F.struct(F.lit(i).alias("i"), F.floor(x).alias("r0"), F.ceil(x).alias("r1"), (x - F.floor(x)).alias("part"), q_of(q - e).alias("lo"), q_of(q + e).alias("hi")) for i, (q, x) in enumerate(zip(qs, at, strict=True))]
    found = rows.groupBy("__k").agg(F.kll_sketch_agg_double("__v", F.lit(size)).alias("__s"), F.count(F.lit(1)).alias("n"))
    limits = stored(found.select("__k", "n", F.array(*bounds).alias("__b")))
    total = limits.agg(F.sum("n")).first()[0] or 0
    v = F.col("__v")

    def place(b):
        below = b["lo"].isNotNull() & (v < b["lo"])
        return F.when(below | b["hi"].isNull() | (v <= b["hi"]), F.struct(b["i"].alias("i"), b["r0"].alias("r0"), b["r1"].alias("r1"), b["part"].alias("part"), F.when(~below, v).alias("v")))

    near = hub_join(rows, limits, "__k", total).select("__k", F.explode(F.filter(F.transform("__b", place), lambda x: x.isNotNull())).alias("x")).select("__k", "x.*")
    counts = near.groupBy(*AT, "v").agg(F.count(F.lit(1)).alias("__n"))  # a null v counts the values below
    exact = _of_ranks(ranking.running_counts(counts, "v", AT))
    out = stored(limits.select("__k").join(exact, "__k", "left"))
    missed = out.where(F.col("q").isNull() | (F.size("q") < len(qs)) | F.exists("q", lambda x: x.isNull())).select("__k")
    if missed.head(1):
        again = rows.join(missed, "__k", "left_semi").groupBy("__k", F.col("__v").alias("v")).agg(F.count(F.lit(1)).alias("__n"))
        ranks = limits.join(missed, "__k", "left_semi").select("__k", F.explode("__b").alias("x")).select("__k", "x.i", "x.r0", "x.r1", "x.part")
        every = again.join(ranks, "__k").select(*AT, "v", "__n")
        out = out.join(missed, "__k", "left_anti").unionByName(_of_ranks(ranking.running_counts(every, "v", AT)))
    return _keys(out, keys, "q")


#: A key, the number of a quantile, the ranks on either side of it and how far it is between them.
AT = ["__k", "i", "r0", "r1", "part"]


def _of_ranks(run: DataFrame) -> DataFrame:
    """(__k, q) from the values that hold the ranks r0 and r1, each with how many there are before it."""
    holds = lambda r: F.max(F.when((F.col("__before") <= F.col(r)) & (F.col(r) < F.col("__before") + F.col("__n")), F.col("v")))
    ends = run.groupBy(*AT).agg(holds("r0").alias("a"), holds("r1").alias("b"))
    q = ends.select("__k", F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q")).alias("e"))
    return q.groupBy("__k").agg(F.array_sort(F.collect_list("e")).alias("e")).select("__k", F.transform("e", lambda x: x["q"]).alias("q"))  # a key's quantiles


def keyed_quantiles(df: DataFrame, keys: list[str], value: Column | str, qs: list[float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(keys, q): an array of exact quantiles of each key, with linear interpolation; nulls and NaN take no part.

    Groups are counted first. If none is larger than group_rows, Spark's percentile does, as its task then holds
    no more than that; else selected() does, whose tasks hold no group. Both give the same values. A key without values has no row.
    """
    rows = _known(df, keys, value)
    largest = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > group_rows:
        return selected(df, keys, value, qs)
    return _keys(rows.groupBy("__k").agg(F.percentile("__v", F.array(*[F.lit(float(q)) for q in qs])).alias("q")), keys, "q")


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], value: Column | str, names: dict[str, float], group_rows: int = GROUP_ROWS) -> DataFrame:
    """grouped (a row for each key of df, null keys alike) with the exact quantiles of df's value as columns; null for a key without values."""
    q = keyed_quantiles(df, keys, value, list(names.values()), group_rows).select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], F.col("q").alias("__q"))
    alike = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__q{i}")) for i, k in enumerate(keys)], F.lit(True))
    return grouped.join(q, alike, "left").select(*grouped.columns, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
