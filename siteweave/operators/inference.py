"""Paired comparisons, rank tests and bootstrap intervals."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import _FACTOR, RANGE, _mixed_number, draw_hash, portable_hash
from ..functions.stats import p_two_sided, t_crit
from .ranking import with_avg_rank


def paired_compare(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean difference own - ref of paired runs with a 95 % t interval, wins and their rate."""
    d = pairs.withColumn("d", F.col("own") - F.col("ref"))
    g = d.groupBy(*keys).agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.count("d").alias("n"), F.count_if(F.col("d") > 0).alias("wins"))
    half = F.when(F.col("n") > 1, t_crit(F.col("n") - 1) * F.col("sd_diff") / F.sqrt("n"))
    return g.withColumns({"lo": F.col("mean_diff") - half, "hi": F.col("mean_diff") + half, "win_rate": F.col("wins") / F.col("n"), "direction": F.when(F.col("mean_diff") > 0, "better").when(F.col("mean_diff") < 0, "worse").otherwise("equal")})


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank test of own - ref, zeros left out: W+, and p by the normal law with correction for ties."""
    d = pairs.withColumn("d", F.round(F.col("own") - F.col("ref"), 12)).where("d <> 0").withColumn("__a", F.abs("d"))
    ranked = with_avg_rank(d, "__a", keys, "__r", "__t")
    g = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.pow("__t", F.lit(2.0)) - 1).alias("tie"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    return g.select(*keys, "w_plus", n.cast("long").alias("n"), p_two_sided(F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(F.nullif(var, F.lit(0.0))))).alias("p"))


def mann_whitney(long: DataFrame, keys: list[str], value: str = "value", group: str = "group") -> DataFrame:
    """Two-sided test of value between group true and false for each variable: U of the true group and p, corrected for ties."""
    r = with_avg_rank(long.where(F.col(value).isNotNull()), value, keys, "__r", "__t")
    g = r.groupBy(*keys).agg(F.count_if(group).cast("double").alias("n1"), F.count_if(~F.col(group)).cast("double").alias("n0"), F.sum(F.when(F.col(group), F.col("__r"))).alias("r1"), F.sum(F.pow("__t", F.lit(2.0)) - 1).alias("tie"))
    n1, n0 = F.col("n1"), F.col("n0")
    n, u = n1 + n0, F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("tie"), n * (n - 1)))
    return g.select(*keys, n1.cast("long").alias("n_true"), n0.cast("long").alias("n_false"), u.alias("u"), p_two_sided(F.try_divide(u - n1 * n0 / 2, F.sqrt(F.nullif(var, F.lit(0.0))))).alias("p"))


#: Distribution of Poisson(1) numbers, up to where a 32-bit hash can't tell more apart.
CUTS = tuple(accumulate(exp(-1) / factorial(i) for i in range(13)))
#: Draws that a task makes at a time, few enough for a core's cache.
DRAWS = 1 << 17


class Draws:
    """boot_weights()' numbers of many hashes at once: draw_hashes() in 32 bits and in place, and a table of the upper 16 bits.

    Where one of CUTS lies among the hashes of an entry, the number is looked up by the whole hash.
    """

    def __init__(self, replicates: int, most: int):
        self.cuts = np.ceil(np.array(CUTS) * RANGE).astype(np.int64)
        edges = np.arange(1 << 16, dtype=np.int64) << 16
        low, high = (np.searchsorted(self.cuts, e, "right") for e in (edges, edges | 0xFFFF))
        self.table = np.where(low == high, low, -1).astype(np.float64)
        self.reps = _mixed_number(np.arange(1, replicates + 1, dtype=np.int64)).astype(np.uint32)
        self.held = [np.empty((most, replicates), t) for t in (np.uint32, np.uint32, np.intp, np.float64)]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each hash (`most` at most), a column for each replicate; the next call writes over it."""
        x, y, entry, w = (h[: len(hashes)] for h in self.held)
        half, factor = np.uint32(16), np.uint32(_FACTOR)
        np.bitwise_xor(hashes.astype(np.uint32)[:, None], self.reps[None, :], out=x)
        for _ in range(2):
            np.bitwise_xor(x, np.right_shift(x, half, out=y), out=x)
            np.multiply(x, factor, out=x)
        np.bitwise_xor(x, np.right_shift(x, half, out=y), out=x)
        entry[:] = y  # the upper half of x
        np.take(self.table, entry, out=w, mode="clip")
        at = np.nonzero(w < 0)
        w[at] = np.searchsorted(self.cuts, x[at].astype(np.int64), "right")
        return w


def boot_weights(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """A row for each row and replicate it is drawn in, with weight w: Poisson(1) numbers from a hash of seed, key and replicate."""
    r = df.withColumns({"__h": portable_hash(F.col(key), seed), "rep": F.explode(F.sequence(F.lit(1), F.lit(replicates)))})
    u = draw_hash(F.col("__h"), F.col("rep")) / float(RANGE)
    w = F.lit(0)
    for c in CUTS:
        w = w + (u >= c).cast("int")
    return r.withColumn("w", w).where("w > 0").drop("__h")


def boot_sums(df: DataFrame, keys: list[str], key: str, sums: dict[str, Column], replicates: int, seed: int, rows_drawn: str | None = None) -> DataFrame:
    """(keys, rep, n, sums): the weighted sums of boot_weights() in each replicate, added up in the tasks, so that no row is repeated.

    A replicate that draws none of a task's rows of a key has zeros from it. Terms are doubles, not null.
    rows_drawn names a further column, for how many rows a replicate draws at least once.
    """
    names = list(sums)
    made = ["n", *names, *([rows_drawn] if rows_drawn else [])]
    slim = df.select(*keys, portable_hash(F.col(key), seed).alias("__h"), *[x.cast("double").alias(n) for n, x in sums.items()])
    slim = slim.repartition(df.sparkSession.sparkContext.defaultParallelism, "__h")  # the tables are a few files
    reps = np.arange(1, replicates + 1)

    def summed(items):
        totals: dict[tuple, np.ndarray] = {}
        step = max(1, DRAWS // replicates)
        drawn = Draws(replicates, step)
        for batch in items:
            if not batch.num_rows:
                continue
            # Rows of one key draw alike: its numbers are drawn once, for whatever groups it is in.
            hashes, at = np.unique(batch.column("__h").to_numpy(zero_copy_only=False), return_inverse=True)
            x = np.column_stack([np.ones(len(at)), *(batch.column(n).to_numpy(zero_copy_only=False) for n in names)])
            who = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(at)
            number: dict[tuple, int] = {}
            group = np.fromiter((number.setdefault(g, len(number)) for g in who), np.int64, len(who))
            first = np.full(len(hashes), len(number))
            np.minimum.at(first, at, group)
            order = np.argsort(first, kind="stable")  # so that a group's keys lie together
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at, hashes = place[at], hashes[order]
            by_group = np.lexsort((at, group))
            ends = np.searchsorted(group[by_group], np.arange(len(number) + 1))
            own = [(g, by_group[ends[i] : ends[i + 1]]) for g, i in number.items()]
            own = [(totals.setdefault(g, np.zeros((len(made), replicates))), rows, at[rows]) for g, rows in own]
            for a in range(0, len(hashes), step):
                w = drawn.weights(hashes[a : a + step])
                for total, rows, places in own:
                    i, j = np.searchsorted(places, (a, a + step))
                    if i == j:
                        continue
                    low, high = places[i] - a, places[j - 1] - a + 1
                    part = np.zeros((high - low, x.shape[1]))
                    np.add.at(part, places[i:j] - a - low, x[rows[i:j]])
                    total[: len(names) + 1] += part.T @ w[low:high]
                    if rows_drawn:
                        total[-1] += part[:, 0] @ (w[low:high] > 0)
        for g, total in totals.items():
            own_keys = {k: pa.array([v] * replicates, schema.field(k).type) for k, v in zip(keys, g, strict=True)}
            yield pa.RecordBatch.from_pydict(own_keys | {"rep": pa.array(reps, pa.int32())} | {n: pa.array(t) for n, t in zip(made, total, strict=True)})

    schema = to_arrow_schema(slim.schema)
    ddl = ", ".join([*(f"`{k}` {dict(slim.dtypes)[k]}" for k in keys), "rep int", *(f"`{n}` double" for n in made)])
    return slim.mapInArrow(summed, ddl).groupBy(*keys, "rep").agg(*[F.sum(n).alias(n) for n in made])


def _group_moments(value: Column, group: Column) -> dict[str, Column]:
    part = lambda g, x: F.when(g, x).otherwise(0.0)
    return {f"__{n}{i}": part(g, x) for n, g in (("a", group), ("b", ~group)) for i, x in enumerate((F.lit(1.0), value, value * value))}


def _cohens_d(sums: DataFrame, keys: list[str], least: int) -> DataFrame:
    n1, n0 = F.col("__a0"), F.col("__b0")
    ss = lambda n: F.col(f"__{n}2") - F.try_divide(F.col(f"__{n}1") * F.col(f"__{n}1"), F.col(f"__{n}0"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(ss("a") + ss("b"), n1 + n0 - 2)))
    d = F.when((n1 >= least) & (n0 >= least) & (sd > 1e-12), F.try_divide(F.try_divide(F.col("__a1"), n1) - F.try_divide(F.col("__b1"), n0), sd))
    return sums.select(*keys, d.alias("d"))


def cohens_d(long: DataFrame, keys: list[str], value: str = "value", group: str = "group", least: int = 5) -> DataFrame:
    """Difference of the group means (true less false) over the pooled deviation; null below least rows or without spread."""
    known = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    sums = {n: F.sum(x).alias(n) for n, x in _group_moments(F.col(value).cast("double"), F.col(group)).items()}
    return _cohens_d(known.groupBy(*keys).agg(*sums.values()), keys, least)


def cohens_d_boot(long: DataFrame, keys: list[str], key: str, replicates: int = 1000, seed: int = 0, value: str = "value", group: str = "group", least: int = 5) -> DataFrame:
    """cohens_d() with a percentile interval over bootstrap replicates."""
    known = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    b = _cohens_d(boot_sums(known, keys, key, _group_moments(F.col(value).cast("double"), F.col(group)), replicates, seed), [*keys, "rep"], least)
    q = b.groupBy(*keys).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    return cohens_d(long, keys, value, group, least).join(q, keys, "left").select(*keys, "d", F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))


def corr_boot(df: DataFrame, keys: list[str], x: str, y: str, key: str, replicates: int = 2000, seed: int = 0, ranks: bool = False) -> DataFrame:
    """Pearson's correlation (of ranks, with ranks) and a percentile interval, from weighted moments."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ranks:
        both = with_avg_rank(with_avg_rank(both, x, keys, "__x"), y, keys, "__y")
    else:
        both = both.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    x_, y_ = F.col("__x"), F.col("__y")
    b = boot_sums(both, keys, key, {"sx": x_, "sy": y_, "xx": x_ * x_, "yy": y_ * y_, "xy": x_ * y_}, replicates, seed)
    r = F.try_divide(F.col("xy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(F.nullif((F.col("xx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")), F.lit(0.0))))
    q = b.withColumn("r", r).groupBy(*keys).agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    return both.groupBy(*keys).agg(F.corr("__x", "__y").alias("r")).join(q, keys, "left").select(*keys, "r", F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))


def paired_boot_mae(a: DataFrame, b: DataFrame, key: str, error: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """MAE of a less MAE of b on the samples of both, with a percentile interval and a verdict by its sign."""
    both = a.select(key, F.abs(error).alias("__a")).join(b.select(key, F.abs(error).alias("__b")), key).withColumn("__d", F.col("__a") - F.col("__b"))
    r = boot_sums(both, [], key, {"__s": F.col("__d")}, replicates, seed).select(F.try_divide("__s", "n").alias("m"))
    q = r.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    out = both.agg(F.avg("__d").alias("diff"), F.count(F.lit(1)).alias("n")).crossJoin(q).select("diff", "n", F.col("__q")[0].alias("lo"), F.col("__q")[1].alias("hi"))  # one row each
    return out.withColumn("verdict", F.when(F.col("hi") < 0, "a better").when(F.col("lo") > 0, "b better").otherwise("no difference"))


def cross_corr(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """(x, y, r) for all pairs of the two short column lists, in one aggregate."""
    one = df.agg(*[F.corr(x, y).alias(f"__{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(ys)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"__{i}_{j}").alias("r")) for i, x in enumerate(xs) for j, y in enumerate(ys)])).alias("e")).select("e.x", "e.y", "e.r")
