"""Shards by proportional stratified interleaving, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Phases that a source's ranks may start from, so that small sources do not all stand at one place.
PHASES = 1024


def interleave(docs: DataFrame, shards: int = 8, source: str = "source", key: str = "doc_id", seed: int = 7, bucket_rows: int = 2000, most_buckets: int = 65536) -> DataFrame:
    """docs with two more columns: shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Rows are ranked in a seeded shuffle within each source; the rank r of n rows stands at the
    fraction (r - u) / n, where u in (0, 1) is drawn from the seed and the source; all rows, sorted
    by fraction, are cut into runs whose sizes differ by one at most, so that every shard holds every
    source in the mixture's proportion, and sources of a few rows are spread over the shards.

    No source is ever sorted by one task: a source's shuffle order is dealt into hash buckets whose
    counts give each bucket the rank it starts from, and the global order into fraction buckets
    whose starts follow from the sources' sizes alone. Rows cross the network twice.

    The shuffle order is that of a hash of the seed and all of a row's columns, so that rows with
    null or repeated keys spread over the buckets too; wholly equal rows are interchangeable. A null
    source is a source of its own (as is the text "\\0"). Null, empty and long texts need nothing. An empty table gives an empty
    result. Columns named shard or slot are replaced. At most 2^37 rows (ANSI mode reports more).
    """
    docs = docs.drop("shard", "slot")
    total = docs.count()
    parts = max(1, min(most_buckets, -(-total // bucket_rows)))
    s, h, b, r, n, u, at, g, tie = (fresh(x) for x in ("source", "hash", "bucket", "rank", "rows", "phase", "start", "fraction", "tie"))
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumns({s: F.coalesce(F.col(source).cast("string"), F.lit("\0")), h: F.xxhash64(F.lit(seed), F.col(key), *plain)})
    keyed = keyed.withColumn(b, F.expr(f"shiftrightunsigned(`{h}`, 33) * {parts} div 2147483648"))

    counts = keyed.groupBy(s, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(s, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(at), F.sum(n).over(Window.partitionBy(s)).alias(n))

    order = Window.partitionBy(s, b).orderBy(h, F.col(key))
    ranked = keyed.withColumn(r, F.row_number().over(order).cast("long")).join(starts, [s, b])
    ranked = ranked.withColumn(r, F.col(r) + F.col(at)).drop(at, b, h)
    ranked = ranked.withColumn(u, _phase(s, seed)).withColumn(g, F.expr(f"({PHASES} * `{r}` - `{u}`) * {parts} div ({PHASES} * `{n}`)"))

    position = F.row_number().over(Window.partitionBy(g).orderBy(F.expr(f"({PHASES} * `{r}` - `{u}`) / ({PHASES} * `{n}`)"), s, r)).cast("long")
    placed = ranked.withColumn(tie, position - 1).join(_fraction_starts(counts, s, n, parts, g, at, seed), g)
    place = F.col(tie) + F.col(at)
    shard = _div(place * shards, F.lit(max(total, 1)))
    slot = place - _div(shard * total + (shards - 1), F.lit(shards))
    return placed.select(*docs.columns, shard.cast("int").alias("shard"), slot.alias("slot"))


def _div(a: Column, b: Column) -> Column:
    return F.floor((a - F.pmod(a, b)) / b).cast("long")


def _phase(source: str, seed: int) -> Column:
    """1 to PHASES - 1, the same for all rows of a source."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(source)), F.lit(PHASES - 1)) + 1


def _fraction_starts(counts: DataFrame, s: str, n: str, parts: int, g: str, at: str, seed: int) -> DataFrame:
    """The number of rows that stand before each fraction bucket.

    Ranks within a source are 1 to n, so the sizes suffice: a large source gives one row for each
    bucket, a small one a row for each rank, never more rows than the table has.
    """
    i, c, u = fresh("i"), fresh("c"), fresh("phase")
    sizes = counts.groupBy(s).agg(F.sum(n).alias(n)).withColumn(u, _phase(s, seed))
    each = sizes.select(n, u, F.explode(F.expr(f"sequence(0L, least(`{n}`, {parts}L) - 1)")).alias(i))
    # Ranks whose bucket is less than x.
    below = lambda x: f"(({PHASES} * `{n}` * {x} + (`{u}` + {PHASES}) * {parts} - 1) div ({PHASES} * {parts}) - 1)"
    each = each.select(
        F.expr(f"CASE WHEN `{n}` >= {parts} THEN `{i}` ELSE ({PHASES} * (`{i}` + 1) - `{u}`) * {parts} div ({PHASES} * `{n}`) END").alias(g),
        F.expr(f"CASE WHEN `{n}` >= {parts} THEN {below(f'(`{i}` + 1)')} - {below(f'`{i}`')} ELSE 1 END").alias(c),
    )
    held = each.groupBy(g).agg(F.sum(c).alias(c))
    return held.select(g, (F.sum(c).over(Window.orderBy(g)) - F.col(c)).alias(at))
