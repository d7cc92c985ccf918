"""Quality by importance resampling over hashed n-gram models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import COUNT_TYPES, appended, batches, count_blocks, lowered_spaces_table, prepare, sequence_hashes, summed_counts, tidy, utf8, with_schema, word_hashes

#: Buckets of the hashed models: the size of what is sent to every task.
BUCKETS = 1 << 17
#: Labelled documents that a target model reads at most, drawn by a hash of their ids.
FIT_ROWS = 20_000


def ngram_buckets(text: bytes, memo: dict, table: bytes = lowered_spaces_table()) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    words = text.translate(table).split()
    if not words:
        return np.empty(0, np.int64)
    h = word_hashes(words, memo)
    return (np.concatenate([h, sequence_hashes(h, 2)]) >> np.uint64(40)).astype(np.int64) % BUCKETS


def bucket_counts(docs: DataFrame, text: str = "text", target: str = "target") -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all of docs and in those whose target is true, from one pass.

    Each task sends small blocks of counts, which are summed by block.
    """
    prepare(docs.sparkSession)

    @tidy
    def counted(items):
        total, memo = np.zeros(2 * BUCKETS, np.int64), {}
        for batch in batches(items):
            for x, chosen in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = ngram_buckets(x, memo)
                np.add.at(total, found, 1)
                if chosen:
                    np.add.at(total, found + BUCKETS, 1)
        blocks, held = count_blocks(total)
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "counts": pa.array(held, pa.binary())})

    got = summed_counts(docs.select(F.col(text).alias("text"), F.col(target).alias("target")).mapInArrow(counted, COUNT_TYPES), 2 * BUCKETS)
    return got[:BUCKETS], got[BUCKETS:]


@dataclass
class Model:
    """ratios: log target over raw rate by bucket, so that a document whose ratios add up to 0 or more counts as the target's."""

    ratios: np.ndarray


def chosen_labels(labels: DataFrame, value: int, key: str, label: str, rows: int) -> DataFrame:
    """(key, part) of at most rows keys with this label; part is 0 to 4, by a hash of the key."""
    chosen = labels.where(F.col(label) == value).select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    return chosen.orderBy(F.xxhash64(key), key).limit(rows).withColumn("part", F.pmod(F.xxhash64(F.lit(1), key), F.lit(5)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """The raw model from all of docs and the target model from documents labelled 1.

    At most rows documents labelled 1 are read, four fifths for the target model. That model has seen
    far fewer n-grams than the raw one, so even the target's own documents lose something on each:
    the ratios are moved by a constant, the mean ratio that separates the labels best among the rest
    of the documents labelled 1 and at most rows / 4 labelled 0. Null keys and labels are ignored,
    repeated labels count once; rows that share a key all have its label. Without documents of both
    labels the constant is 0; without any labelled 1, as with an empty table, all ratios are 0. The
    texts are read once in full, and those of the chosen labels once more.
    """
    slim = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    good, bad = checkpointed(chosen_labels(labels, 1, key, label, rows)), chosen_labels(labels, 0, key, label, rows // 4)
    target = F.broadcast(good.where("part > 0").select(key, F.lit(True).alias("target")))
    raw, seen = bucket_counts(slim.join(target, key, "left"), text)
    ratios = log_ratios(seen, raw)
    mean = F.try_divide("log_weight", "n_grams").alias("mean")
    means = [weigh(slim.join(F.broadcast(x), key), ratios, key, text).where("n_grams > 0").select(mean).toPandas()["mean"].to_numpy() for x in (good.where("part = 0"), bad)]
    return Model(ratios - np.float32(best_cut(*means)))


def best_cut(good: np.ndarray, bad: np.ndarray, regret: float = 3.0) -> float:
    """The middle of the gap that loses least, where a lost good value costs regret times a kept bad one."""
    if not len(good) or not len(bad):
        return 0.0
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[at[0] - 1e-6], (at[1:] + at[:-1]) / 2])
    cost = regret * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(np.median(cuts[cost <= cost.min() + 1e-12]))


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw rate by bucket; both models are smoothed with the raw model's shape."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS, np.float32)
    shape = (raw + smoothing) / (raw.sum() + smoothing * BUCKETS)
    strength = smoothing * BUCKETS
    t = (target + strength * shape) / (target.sum() + strength)
    return np.log(t / shape).astype(np.float32)


def weigh(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """docs with n_grams, log_weight and gumbel_key.

    log_weight is the log of the importance weight, the likelihood of the document's n-grams under
    the target model over that under the raw one: the sum of their log ratios. gumbel_key adds
    Gumbel noise drawn from a hash of the seed, the key and the text.
    """
    import xxhash

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @tidy
    def weighed(items):
        r, memo = shared.value, {}
        for batch in batches(items):
            n, sums, keys = [], [], []
            for k, x in zip(batch.column(key).to_pylist(), utf8(batch.column(text)), strict=True):
                b = ngram_buckets(x, memo)
                one = float(r[b].sum(dtype=np.float64))
                u = (xxhash.xxh3_64_intdigest(x, seed=xxhash.xxh3_64_intdigest(f"{seed} {k}".encode())) + 0.5) / 2.0**64
                n.append(len(b))
                sums.append(one)
                keys.append(one - float(np.log(-np.log(min(max(u, 1e-18), 1 - 1e-16)))))
            yield appended(batch, {"n_grams": pa.array(n, pa.int64()), "log_weight": pa.array(sums, pa.float64()), "gumbel_key": pa.array(keys, pa.float64())})

    return docs.mapInArrow(weighed, with_schema(docs, {"n_grams": "bigint", "log_weight": "double", "gumbel_key": "double"}))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of a column without a global sort: the range is narrowed by histograms."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    for _ in range(12):
        if not low < high:
            break
        width = (high - low) / bins
        if not width > 0:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        inside = keys.where(F.col(column).between(low, high)).groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z"))
        for row in inside.orderBy(F.desc("b")).collect():  # bins rows at most
            if row["n"] >= k:
                low, high = row["a"], row["z"]
                break
            k -= row["n"]
        else:
            return low
    return low


def resample(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", share: float | None = None, seed: int = 5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_grams, log_weight, gumbel_key and kept.

    A document's importance weight is its likelihood under the target over that under the raw model,
    and Gumbel top-k keeps k documents, a sample without replacement in proportion to the weights. k
    is share of the documents, or without share the number of documents with a weight of 1 or more
    (those that tie with the k-th key stay).

    Null and empty texts have no n-grams and log weight 0. Repeated rows get equal keys, so they
    stay or go together. Columns of the result's names are replaced. An empty table gives an empty
    result. The texts are not shuffled, and read twice, or once if keep leaves the text out.
    """
    names = ["n_grams", "log_weight", "gumbel_key"]
    weighed = weigh(docs, model.ratios, key, text, seed)
    small = keep is not None and text not in keep
    known = checkpointed(weighed.select(*keep, *names) if small else weighed.select("gumbel_key", "log_weight"))
    total, likely = known.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= 0)).first()
    least = kth_largest(known, "gumbel_key", likely if share is None else round(share * total))
    out = known if small else weighed if keep is None else weighed.select(*keep, *names)
    return out.withColumn("kept", F.col("gumbel_key") >= F.lit(least))
