"""Spelling variants of words: pairs one edit apart, found by pivotal bigrams, and the form that each word varies."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import batches, prepare, utf8

#: Distinct words that a task counts before it passes its counts on.
TASK_WORDS = 200_000
#: Bytes of characters that are neither ASCII nor U+00C0 to U+00FF, which end a run of letters.
_OTHER = re.compile(rb"[\xC2\xC4-\xFF][\x80-\xBF]*")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Letters in all, A-Z lowered: a-z and U+00C0 to U+00FF, so there are at most 90 * 90 bigrams.
MOST_BIGRAMS = 8100


def letter_runs(text: bytes) -> list[bytes]:
    """Maximal runs of [A-Za-zÀ-ÿ] with A-Z lowered."""
    return _OTHER.sub(b" ", text).translate(_LETTERS).split()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, least: int = 5, lose: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least so many code points that occur at least `least` times in all texts.

    A task counts its words before anything is shuffled, and passes on what it has when TASK_WORDS
    distinct ones are reached. lose: where it divides h, the CRC-32 of `<key>:<run>`, the run loses its
    code point h % length (deliberate misspellings, the same for each run of a document). Null texts
    have no words, a null key is empty in `<key>:`; rows that repeat count as often as they occur.
    """
    prepare(docs.sparkSession)

    def counted(items):
        found: Counter = Counter()
        for batch in batches(items):
            for k, t in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                prefix = zlib.crc32(k + b":")
                for run, n in Counter(letter_runs(t)).items():
                    if len(run) < letters:
                        continue
                    if lose and not (h := zlib.crc32(run, prefix)) % lose:
                        s = run.decode()
                        at = h % len(s)
                        run = (s[:at] + s[at + 1 :]).encode()
                    if len(run) - run.count(b"\xc3") >= letters:
                        found[run] += n
                if len(found) >= TASK_WORDS:
                    yield counts(found)
                    found.clear()
        yield counts(found)

    def counts(found):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()).cast(pa.string()), "n": pa.array(found.values(), pa.int64())})

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def pivots(places: list[int], weights: list[int], k: int) -> list[int]:
    """k of the places (ascending) of bigrams that don't overlap, of least total weight; by dynamic programming."""
    none = (float("inf"), ())
    best = [[(0, ())] + [none] * k]  # best[i][j]: the cheapest j of the first i places
    for i, p in enumerate(places):
        free = i if not i or places[i - 1] < p - 1 else i - 1  # places of which none overlaps this one
        row = [(0, ())]
        for j in range(1, k + 1):
            cost, chosen = best[free][j - 1]
            row.append(min(best[i][j], (cost + weights[i], (*chosen, p))))
        best.append(row)
    return list(best[-1][k][1])


def grams(word: str, rank: dict[str, int], weight: dict[str, int]) -> tuple[list[int], list[int]]:
    """(prefix, pivots) as places of bigrams: those up to the third in the order of rank, and two of them that don't overlap."""
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[2]
    prefix = [i for i, r in enumerate(ranks) if r <= last]
    return prefix, pivots(prefix, [weight[word[i : i + 2]] for i in prefix], 2)


def meeting_keys(word: str, place: int, other: int) -> list[str]:
    """What a word of length `other`, one edit from word, shares with it if the bigram at place is not edited.

    The edit is on one side of the bigram, so the other side is the same and fixes the bigram's
    position. If that side is the shorter one, half of the edited side joins it: the half next to the
    bigram if the edit is beyond it, else the half at the far end, both counted in the shorter word.
    """
    n, gram = len(word), word[place : place + 2]
    out = []
    for side, kept, rest in (("<", word[:place], word[place + 2 :]), (">", word[place + 2 :], word[:place])):
        size = min(len(rest), len(rest) + other - n)
        if size < 0 or max(len(rest), len(rest) + other - n) < 1:
            continue
        at = f"{side}{len(kept)} {gram}{kept} "
        half = size // 2
        if len(kept) >= size:
            out.append(at)
        elif side == "<":
            out += [f"{at}n{rest[:half]}"] + [f"{at}f{rest[len(rest) - size + half :]}"] * (half > 0)
        else:
            out += [f"{at}n{rest[len(rest) - half :]}"] + [f"{at}f{rest[: size - half]}"] * (half > 0)
    return out


def signatures(words: DataFrame, rank: dict[str, int], weight: dict[str, int], pivotal: bool) -> DataFrame:
    """(at, word, n): each word under the keys of its pivots, or of its prefix, for other words of its length and of one more or less."""

    def signed(items):
        import xxhash

        for batch in batches(items):
            at, back = [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                prefix, chosen = grams(w, rank, weight)
                own = len(w)
                for p in chosen if pivotal else prefix:
                    for other in (own - 1, own, own + 1):
                        lengths = f"{own},{other}" if pivotal else f"{other},{own}"
                        keys = meeting_keys(w, p, other)
                        at += [xxhash.xxh3_64_intdigest(f"{lengths}{k}") for k in keys]
                        back += [i] * len(keys)
            rows = batch.take(pa.array(back, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.uint64).view(np.int64)), *rows.columns], names=["at", "word", "n"])

    return words.select("word", "n").mapInArrow(signed, "at bigint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, n): every pair of distinct words (word, n) one inserted, deleted or replaced code point apart, both ways round; n is the other's.

    Two disjoint bigrams of a word, its pivots, can't both be hit by one edit. The one that is left
    is a bigram of the other word; of two near words, the one whose third rarest bigram is the rarer
    has its pivots in the other's prefix, the bigrams up to its third rarest. So pivots of every word
    are joined with prefixes of all, by keys that also hold what the position of the bigram fixes
    (meeting_keys), and what meets is verified. Words have at least 4 code points.
    """
    counted = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    weight = {r["g"]: r["n"] for r in counted.collect()}  # MOST_BIGRAMS at most
    rank = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
    a = signatures(words, rank, weight, True)
    b = signatures(words, rank, weight, False).select("at", F.col("word").alias("other"), F.col("n").alias("m"))
    # A word has dozens of keys, which Spark sizes as one row: broadcast, they would fill the driver.
    met = a.join(b.hint("merge"), "at").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    both = met.select(F.explode(F.array(F.struct("word", "other", F.col("m").alias("n")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), "n"))).alias("p")).select("p.*")
    return both.groupBy("word", "other").agg(F.first("n").alias("n"))


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of words (word, n), a table of distinct words of 4 letters or more.

    form is the near word of largest n (ties: the smallest) if that n is at least ratio times the
    word's own, ratio 2 or more; root is the last word on the way from form to form, the word itself
    without one. n grows by ratio with each form, so ways are short; each round doubles what is followed.
    Every count is at least 1. An empty table gives an empty result.
    """
    prepare(words.sparkSession)
    words = stored(words.select("word", "n"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    strong = -F.col("best.less") >= F.col("n") * ratio
    found = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(ways.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if not longer.where("moved").head(1):
            break
    return found.join(ways.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
