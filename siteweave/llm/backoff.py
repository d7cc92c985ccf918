"""Language-model scores by stupid backoff, from hash-partitioned count tables joined to exploded n-grams."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from .common import batches, prepare, sequence_hashes, word_hashes

#: Words of which a task sums up the n-grams before it hands them on.
HELD_WORDS = 2_000_000


def word_array(texts: pa.Array, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of an Arrow column of texts, in order; each distinct word of the column is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    n = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    at, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
    full = np.array([len(w) > 0 for w in words], bool)  # splitting leaves an empty word where white space begins or ends a text
    if not full.all():
        kept = full[at]
        at, doc = at[kept], doc[kept]
    return word_hashes(words, memo)[at], doc


def ending(texts: pa.Array, low: int, high: int, memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For all words of texts: the text of each, its place there from 0, how many words follow it there, and for each order from low to high the hash of the n-gram that ends with it.

    A hash of order k means nothing at places before k - 1.
    """
    flat, doc = word_array(texts, memo)
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    hashes = {}
    for k in range(low, high + 1):
        hashes[k] = np.zeros(len(flat), np.uint64)
        hashes[k][k - 1 :] = sequence_hashes(flat, k)
    return doc, place, np.repeat(n, n) - place - 1, hashes


def held(items, most: int = HELD_WORDS):
    """The texts of Arrow batches (their first column), some together until they have about so many words."""
    now, size = [], 0
    for batch in batches(items):
        now.append(batch.column(0))
        size += batch.column(0).nbytes
        if size > 6 * most:
            yield pa.concat_arrays(now)
            now, size = [], 0
    if now:
        yield pa.concat_arrays(now)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def gram_counts(docs: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    """(gram, c) of n-grams of orders low to high. Tasks sum them up first, as far as HELD_WORDS goes, so a common one has few rows."""
    prepare(docs.sparkSession)

    def counted(items):
        memo: dict = {}
        for some in held(items):
            _, place, _, hashes = ending(some, low, high, memo)
            for k, h in hashes.items():
                grams, n = np.unique(h[place >= k - 1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": _signed(grams), "n": pa.array(n)})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(counted, "gram long, n long")
    # Dealt out before the sum: a task's rows are distinct already, and summing them once more would only fill its memory.
    return rows.repartition("gram").groupBy("gram").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, corpus: DataFrame | None = None, key: str = "doc_id", text: str = "text", order: int = 3, least: int = 1, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score): stupid-backoff scores of whole documents.

    Words are runs without white space, A-Z lowered; every word of the corpus keeps its own count. A
    word scores log(c(n-gram) / c(n-gram without its last word)) for the n-gram of `order` words that
    ends with it (of all words up to it, near the start), if that occurs `least` times or more in the
    corpus; else log(alpha) and its score by the n-gram without the first word. A lone word scores
    log(c / N); one without any count counts as seen once.

    Relationally: n-grams are 64-bit hashes. Tasks explode texts into n-grams of each order with
    their numbers; a count table, dealt out by hash, sums them. The documents' own n-grams are joined
    to it and summed by document. Nothing that grows with the corpus is broadcast.

    corpus is docs unless given. Rows that share a key are one document, whose n-grams stay inside
    their rows; a null key is a document. Null and empty texts have no words, log_score 0 and a null
    mean. Other columns are not returned. Empty tables give an empty result.
    """
    if order < 1:
        raise ValueError("an order of 1 at least")
    prepare(docs.sparkSession)
    if (corpus is None or corpus is docs) and least <= 1:
        got = _own_scores(docs, key, text, order)
    else:
        got = _scores(docs, docs if corpus is None else corpus, key, text, order, least, alpha)
    return got.select("doc_id", "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))


def _own_scores(docs: DataFrame, key: str, text: str, order: int) -> DataFrame:
    """Scores of the corpus itself, which has each of its n-grams, so that nothing backs off.

    Then the score of a document is a sum of log counts: plus one for each n-gram that scores a word,
    less one for each that is the context of one. Both cancel at the start of a text, so that below the two
    highest orders only texts of so few words have any. The n-grams of the two highest orders are dealt
    out once each, with their documents, and counted where they meet; one that occurs once in the
    corpus adds log 1, so only the counts from 2 on are joined.
    """
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))

    def lengths(items):
        for batch in batches(items):
            trimmed = pc.ascii_trim_whitespace(pc.fill_null(batch.column(1), ""))
            n = pc.list_value_length(pc.ascii_split_whitespace(trimmed)).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pc.if_else(pc.equal(trimmed, ""), pa.scalar(0, pa.int64()), n)})

    words = stored(slim.mapInArrow(lengths, f"doc_id {kind}, n_words long"))
    total, short = words.agg(F.sum("n_words"), F.max(F.col("n_words").between(1, order - 2))).first()
    # Words without a context are scored by the length of the corpus: the first of a text, or all if the order is 1.
    start = F.lit(-float(np.log(max(total or 0, 1)))) * (F.col("n_words") if order == 1 else F.least("n_words", F.lit(1)))
    parts = [words.select("doc_id", "n_words", start.alias("s"))]

    def summed(joined: DataFrame) -> DataFrame:
        """Stored before the next part, so that its exchanges need not be kept."""
        return stored(joined.groupBy("doc_id").agg(F.lit(0).cast("long").alias("n_words"), F.sum(F.col("n") * F.log("c")).alias("s")))

    def rows(low: int, high: int, every: bool) -> DataFrame:
        def run(items):
            """(document, n-gram, whether its log count is added or taken off), in the order of documents, which an exchange packs best; with n-grams of neither kind, if every."""
            memo: dict = {}
            for batch in batches(items):
                doc, place, after, hashes = ending(batch.column(1), low, high, memo)
                for k, h in hashes.items():
                    scores = np.minimum(order, place + 1) == k
                    context = (after > 0) & (np.minimum(order - 1, place + 1) == k)
                    sign = scores.astype(np.int8) - context
                    at = np.flatnonzero(place >= k - 1 if every else sign)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(doc[at], pa.int64())), "gram": _signed(h[at]), "n": pa.array(sign[at])})

        return slim.mapInArrow(run, f"doc_id {kind}, gram long, n byte")

    if short:
        often = gram_counts(docs, 1, order - 2, text).where("c > 1")
        parts.append(summed(rows(1, order - 2, False).join(often.hint("shuffle_hash"), "gram")))
    for k in range(max(order - 1, 1), order + 1):
        dealt = rows(k, k, True).repartition("gram")
        # The count reads all columns, or they would be cut from its side and the exchange made twice.
        often = dealt.groupBy("gram").agg(F.sum(F.expr("1 + 0 * (n + int(isnull(doc_id)))")).alias("c")).where("c > 1")
        parts.append(summed(dealt.join(often.hint("shuffle_hash"), "gram")))
    return reduce(lambda a, b: a.union(b), parts).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("log_score"))


def _scores(docs: DataFrame, corpus: DataFrame, key: str, text: str, order: int, least: int, alpha: float) -> DataFrame:
    """Scores by another corpus, or with a least count: the table of each order is joined to that of the order below, for contexts and lower scores."""

    def linked(df: DataFrame, weight: int) -> DataFrame:
        """(k, gram, prefix, suffix, n): prefix and suffix are the n-gram without its last and without its first word, by their hashes."""

        def counted(items):
            memo: dict = {}
            for some in held(items):
                _, place, _, hashes = ending(some, 1, order, memo)
                for k, h in hashes.items():
                    at = np.flatnonzero(place >= k - 1)
                    grams, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    at = at[first]
                    parts = [hashes[k - 1][at - 1], hashes[k - 1][at]] if k > 1 else [np.zeros(len(at), np.uint64)] * 2
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k, np.int32)), "gram": _signed(grams), "prefix": _signed(parts[0]), "suffix": _signed(parts[1]), "n": pa.array(n * weight)})

        return df.select(F.col(text).alias("t")).mapInArrow(counted, "k int, gram long, prefix long, suffix long, n long")

    exploded = linked(corpus, 1) if corpus is docs else linked(corpus, 1).union(linked(docs, 0))
    grams = checkpointed(exploded.groupBy("gram").agg(F.min("k").alias("k"), F.min("prefix").alias("prefix"), F.min("suffix").alias("suffix"), F.sum("n").alias("c")))
    total = grams.where("k = 1").agg(F.sum("c")).first()[0] or 0
    log_n, log_alpha = float(np.log(max(total, 1))), float(np.log(alpha))
    below = grams.where("k = 1").select("gram", "c", (F.log(F.greatest("c", F.lit(1))) - F.lit(log_n)).alias("s"))
    scores = below.select("gram", "s")
    for k in range(2, order + 1):
        context = below.select(F.col("gram").alias("prefix"), F.col("c").alias("of"))
        found = grams.where(F.col("k") == k).join(context, "prefix").join(below.select(F.col("gram").alias("suffix"), F.col("s").alias("lower")), "suffix")
        hit = F.when(F.col("c") >= max(least, 1), F.log("c") - F.log("of")).otherwise(F.col("lower") + F.lit(log_alpha))
        below = checkpointed(found.select("gram", "c", hit.alias("s")))
        # Of lower orders, only the first words of a row are scored by themselves; all are offered.
        scores = scores.union(below.select("gram", "s"))

    kind = dict(docs.dtypes)[key]

    def run(items):
        """The distinct n-grams by which each document's words are scored; a document without words has a row that finds nothing."""
        memo: dict = {}
        for batch in batches(items):
            doc, place, _, hashes = ending(batch.column(1), 1, order, memo)
            top = hashes[1].copy()
            for k in range(2, order + 1):
                np.copyto(top, hashes[k], where=place >= k - 1)
            _, first, n = np.unique(top + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
            none = np.setdiff1d(np.arange(batch.num_rows), doc)
            at = np.concatenate([doc[first], none])
            gram = np.concatenate([top[first].view(np.int64), -1 - none])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(at, pa.int64())), "gram": pa.array(gram), "n": pa.array(np.concatenate([n, np.zeros(len(none), np.int64)]))})

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, gram long, n long")
    return rows.join(scores, "gram", "left").groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.col("n") * F.col("s")), F.lit(0.0)).alias("log_score"))
