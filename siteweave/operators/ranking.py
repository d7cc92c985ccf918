"""Ranks, top rows and reports in order."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .skew import hub_join


def counted_values(df: DataFrame, value: str, keys: list[str], n: str = "__n", before: str = "__before") -> DataFrame:
    """(keys, value, n, before): how often each value occurs, and how many smaller ones its key has. Nulls take no part.

    Values are counted first, so ties cost nothing.
    """
    return running_counts(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n)), value, keys, n, before)


def running_counts(counts: DataFrame, value: str, keys: list[str], n: str = "__n", before: str = "__before") -> DataFrame:
    """counts (keys, value, n: one row each) with how many rows its key has at smaller values; a null value is the smallest.

    They are dealt by ranges of keys and value, and each range adds what the ranges before it hold
    of the same key, so that no key is sorted by one task. The dealt rows are checkpointed, as a
    range's number must not change.
    """
    dealt = checkpointed(counts.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__p").agg(F.sum(n).alias("__s"))  # a row for each range and key in it
    offset = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__p")) - F.col("__s")
    at = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), offset.alias("__o"))
    within = F.sum(n).over(Window.partitionBy("__p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    ranked = dealt.withColumn("__w", within)
    return ranked.join(at, _alike(keys, F.col("__p") == F.col("__q"))).select(*keys, value, n, (F.col("__w") + F.col("__o")).alias(before))


def _alike(keys: list[str], and_: Column) -> Column:
    """The join of keys, nulls alike, with the columns __k0, __k1, ..."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], and_)


def with_avg_rank(df: DataFrame, value: str, keys: list[str], out: str, ties: str | None = None) -> DataFrame:
    """df with the rank of value within keys, equal values sharing their mean rank (nulls have none), and in ties how many share it.

    Rows find the rank of their value by a join; a value that many rows have, as of an indicator, is joined where they lie.
    """
    at = F.struct(*[F.col(k) for k in keys], F.col(value)).alias("__at")
    counted = counted_values(df, value, keys).select(at, F.col("__n").alias("n"), (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(out), *([F.col("__n").alias(ties)] if ties else []))
    counted = checkpointed(counted)
    columns = [*df.columns, out, *([ties] if ties else [])]
    ranked = hub_join(df.where(F.col(value).isNotNull()).withColumn("__at", at), counted, "__at", counted.agg(F.sum("n")).first()[0] or 0).select(*columns)
    none = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.union((none.withColumn(ties, F.lit(None).cast("long")) if ties else none).select(*columns))


def quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles over the whole table with linear interpolation, without gathering its values; nulls and NaN take no part."""
    known = df.select(F.col(value).cast("double").alias("__v")).where(~F.isnan("__v"))
    values = checkpointed(counted_values(known, "__v", []))
    n = values.agg(F.sum("__n")).first()[0]
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    ranks = sorted({r for x in at for r in (floor(x), ceil(x))})
    holds = [(F.col("__before") <= r) & (F.col("__before") + F.col("__n") > r) for r in ranks]
    found = values.where(reduce(lambda a, b: a | b, holds)).collect()  # a row for each rank at most
    of = {r: next(x["__v"] for x in found if x["__before"] <= r < x["__before"] + x["__n"]) for r in ranks}
    return [of[floor(x)] + (of[ceil(x)] - of[floor(x)]) * (x - floor(x)) for x in at]


def global_rank(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """df with rank (mean of equals) and row (1 to n) over the whole table; nulls come last, equal values by a hash of the row.

    Neither the table nor equal values are sorted by one task: values are counted and the counts
    ranked by ranges, rows are numbered within their value by ranges of the hash, and a value that many rows
    have is joined where they lie.
    """
    value = F.struct(F.col(column)).alias("__value")
    counts = checkpointed(running_counts(df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")), column, []))
    total, none = counts.agg(F.sum("__n"), F.sum(F.when(F.col(column).isNull(), F.col("__n")))).first()
    total, none = total or 0, none or 0
    up = F.col("__before") - none
    before = F.when(F.col(column).isNull(), total - none).otherwise(total - none - up - F.col("__n") if descending else up)
    places = counts.select(value, F.col("__n").alias("n"), before.alias("__b"), F.col("__n").alias("__e"))
    numbered = numbered_within(df.withColumn("__value", value), "__value", [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])], "__t")
    out = hub_join(numbered, places, "__value", total)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__b") + (F.col("__e") + 1) / 2.0).alias("rank"), (F.col("__b") + F.col("__t") + 1).alias("row"))


def numbered_within(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """df with the number from 0 of each row among those of its key, in order, without a task that holds a whole key.

    Rows are dealt by ranges of key and order and checkpointed, as a range's number must not change;
    each range numbers its own and adds what the ranges before it hold of the key. order decides ties. Null keys are alike.
    """
    dealt = checkpointed(df.repartitionByRange(F.col(key), *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__s"))  # a row for each range and key in it
    before = F.sum("__s").over(Window.partitionBy(key).orderBy("__p")) - F.col("__s")
    at = sizes.select(F.col(key).alias("__key"), F.col("__p").alias("__q"), before.alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p", key).orderBy(*order)) - 1
    ranked = dealt.withColumn("__w", own)
    return ranked.join(at, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__q"))).withColumn(out, F.col("__w") + F.col("__b")).drop("__p", "__q", "__key", "__w", "__b")


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__a"), F.col(y).alias("__b"))
    ranked = with_avg_rank(with_avg_rank(both, "__a", keys, "__x"), "__b", keys, "__y")
    return ranked.groupBy(*keys).agg(F.coalesce(F.nullif(F.corr("__x", "__y"), F.lit(float("nan"))), F.lit(0.0)).alias("rho"))


def bh_fdr(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """q-values of Benjamini and Hochberg within keys; a null p has none. Tests of one family are few."""
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    some = F.col(p).isNotNull()
    n = F.count(p).over(part)
    up = F.row_number().over(part.orderBy(F.asc_nulls_last(p)))
    ranked = df.withColumn("__v", F.when(some, F.col(p) * n / up)).withColumn("__u", up)
    q = F.least(F.lit(1.0), F.min("__v").over(part.orderBy(F.desc("__u")).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("q", F.when(some, q)).drop("__v", "__u")


def status_summary(log: DataFrame, status: str) -> DataFrame:
    n = log.agg(F.count(F.lit(1)).alias("__all"))
    return log.groupBy(status).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select(status, "n", (100.0 * F.col("n") / F.col("__all")).alias("percent"))  # one row


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def representative_run(runs: DataFrame, keys: list[str], metric: str = "r2", seed: str = "run_seed") -> DataFrame:
    """The seed of each key whose metric is nearest to the mean, the smallest of equals."""
    m = runs.withColumn("__d", F.abs(F.col(metric) - F.avg(metric).over(Window.partitionBy(*keys))))
    return m.groupBy(*keys).agg(F.min_by(seed, F.struct(F.round("__d", 12), F.col(seed))).alias(seed))


def best_by(df: DataFrame, keys: list[str], metric: str, what: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(what, metric).alias(what), F.max(metric).alias(metric))


def capture_curve(df: DataFrame, score: str, error: str, fractions: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """(fraction, m, share, lift): the share of all error among the m rows of highest score."""
    ranked = global_rank(df.select(score, F.abs(error).alias("__abs")), score, descending=True)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    ms = [F.greatest(F.lit(1).cast("long"), F.bround(f * F.col("__n")).cast("long")) for f in fractions]
    sums = ranked.crossJoin(F.broadcast(n)).agg(F.max("__n").alias("__n"), F.sum("__abs").alias("__t"), *[F.sum(F.when(F.col("row") <= m, F.col("__abs"))).alias(f"__s{i}") for i, m in enumerate(ms)])  # one row
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), m.alias("m"), F.try_divide(F.col(f"__s{i}"), F.col("__t")).alias("share")) for i, (f, m) in enumerate(zip(fractions, ms, strict=True))]))
    return sums.select(each.alias("e")).select("e.fraction", "e.m", "e.share", (F.col("e.share") / F.col("e.fraction")).alias("lift"))
