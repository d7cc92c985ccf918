"""Nearest neighbours from a forest of sorted hash strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, prepare

#: Rows of one forest on the average: what a task holds.
FOREST_ROWS = 16_384
#: Vectors that the hash functions are drawn from, at most.
FIT_ROWS = 2_000
BITS = 62


def planes(sample: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals of trees * BITS hyperplanes at random; each parts the sample in halves."""
    normals = np.random.default_rng(seed).standard_normal((trees * BITS, sample.shape[1]))
    return normals, np.median(sample @ normals.T, axis=0)


class Forest:
    """Per tree the rows' hash strings as sorted numbers; a prefix is a run of the sorted array."""

    def __init__(self, vectors: np.ndarray, normals: np.ndarray, offsets: np.ndarray):
        self.vectors, self.normals, self.offsets = vectors, normals, offsets
        self.trees = len(offsets) // BITS
        strings = self.hashed(vectors)
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order, strict=True)]

    def hashed(self, x: np.ndarray) -> np.ndarray:
        """One number of BITS bits for each tree and row, the first hash function in the highest bit."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            own = slice(t * BITS, (t + 1) * BITS)
            bits = x @ self.normals[own].T > self.offsets[own]
            out[t] = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        return out

    def candidates(self, queries: np.ndarray, want: int):
        """Rows for each query: descend to the longest matching prefix in every tree, then ascend
        all trees level by level until the runs hold want rows (repeats included) together."""
        strings = self.hashed(queries)
        depths = np.arange(BITS, -1, -1)
        low, high = (np.empty((self.trees, len(depths), len(queries)), np.int64) for _ in range(2))
        for t in range(self.trees):
            for k, depth in enumerate(depths):
                first = (strings[t] >> (BITS - depth)) << (BITS - depth)
                low[t, k] = np.searchsorted(self.sorted[t], first, "left")
                high[t, k] = np.searchsorted(self.sorted[t], first + (1 << (BITS - depth)), "left")
        size = (high - low).sum(axis=0)
        level = np.minimum((size < want).sum(axis=0), len(depths) - 1)
        for q in range(len(queries)):
            k = level[q]
            taken = np.zeros(len(self.order[0]), bool)
            for t in range(self.trees):
                taken[self.order[t][low[t, k, q] : high[t, k, q]]] = True
            yield np.flatnonzero(taken)


def _nearest(forest: Forest, ids: list[list[int]], own: list[int], q: np.ndarray, want: int, k: int) -> pa.RecordBatch:
    """The k nearest candidates of each query but the query's own row; ids has the rows of each vector."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for i, rows in enumerate(forest.candidates(q, want)):
        s = forest.vectors[rows] @ q[i]
        if len(s) > k + 1:
            cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            rows, s = rows[s >= cut], s[s >= cut]
        best = sorted((-float(a), j) for a, r in zip(s, rows, strict=True) for j in ids[r] if j != own[i])[:k]
        out["query_id"] += [own[i]] * len(best)
        out["vec_id"] += [j for _, j in best]
        out["score"] += [-a for a, _ in best]
    return pa.RecordBatch.from_pydict({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def neighbours(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 32, probe: float = 0.6, seed: int = 3, forest_rows: int = FOREST_ROWS, most_tasks: int = 100_000) -> DataFrame:
    """The k nearest rows found for each query row, by largest inner product: query_id, rank, vec_id, score.

    is_query is a condition on the columns. Each tree has hash strings of BITS bits; a bit says on
    which side of a random hyperplane a vector lies; a plane lies where it halves a bounded sample. Rows are
    dealt into forests of about forest_rows rows by a hash of the vector, each built once; every query
    searches every forest: it descends to its longest matching prefix in each tree and ascends all
    trees together until their runs hold probe times the forest's rows, repeats included. Scores are
    inner products in double precision of the original vectors, ties go to the smaller id.

    Equal vectors are indexed once, with their k + 1 smallest ids, which is all a result can need.
    A row is no neighbour of its own. Vectors that are null, empty, zero, of another length than the
    commonest, or hold a null or a number that is not finite take no part, as do rows without an id.
    Rows that repeat an id and vector count once. Other columns are ignored. Empty: empty result.
    """
    v = F.col(vector)
    sound = vectors.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False)).alias("q"))
    sound = sound.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    first = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    d, n = first["d"], first["n"]
    sound = sound.where(F.size("v") == d)
    forests = max(1, -(-n // forest_rows))
    order = F.xxhash64(F.lit(seed), "v")
    sample = np.array([r["v"] for r in sound.select("v", order.alias("h")).orderBy("h").limit(FIT_ROWS).collect()])
    shared = spark.sparkContext.broadcast(planes(sample, trees, seed))

    w = Window.partitionBy("v").orderBy("id")
    alike = sound.select("id", "v").distinct().withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1)
    index = alike.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("f", F.pmod(F.xxhash64("v"), F.lit(forests)))
    asked = sound.where("q").select("id", "v").distinct().withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(forests - 1).cast("long"))))
    both = index.select("f", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "ids", "v").union(asked.select("f", F.lit(1), "id", F.lit(None).cast("array<bigint>"), "v"))
    # A task takes one forest after the other: its rows come first and are indexed once, then its queries pass by in batches.
    placed = both.repartition(min(forests, most_tasks), "f").sortWithinPartitions("f", "kind").select("f", "kind", "id", "ids", "v")

    def searched(items):
        now, x, ids, forest = None, [], [], None
        for batch in batches(items):
            f, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            v = np.asarray(batch.column(4).flatten()).reshape(-1, d)
            cuts = np.flatnonzero((f[1:] != f[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(f)], strict=True):
                if f[a] != now:
                    now, x, ids, forest = f[a], [], [], None
                if kind[a] == 0:
                    x.append(v[a:z])
                    ids += batch.column(3).slice(a, z - a).to_pylist()
                    continue
                if x:
                    x, forest = [], Forest(np.concatenate(x), *shared.value)
                if forest is not None:
                    yield _nearest(forest, ids, batch.column(2).slice(a, z - a).to_pylist(), v[a:z], int(probe * len(ids)) + 30 * k, k)

    found = placed.mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
