"""Jaccard similarity join of shingle sets by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hub_join
from ..session import checkpointed, stored
from .common import batches, lowered_spaces_table, prepare, release, sequence_hashes, tidy, utf8, word_hashes

#: A mark of a key is (3 * its class + its kind + 3) times this, plus the keys of its kind that its set may leave out.
MARK_SPARE = 1 << 20

#: Sets and shingles of one block; a larger group is searched block against block.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 2_000_000

#: Bytes of a group after which its worker gives its memory back; for smaller ones that would take longer than their search.
LARGE_GROUP = 1 << 20


def shingles(text: bytes, n: int, memo: dict, table: bytes = lowered_spaces_table()) -> np.ndarray:
    """The set of hashes of n-word shingles, ascending; of the whole sequence, if it is shorter."""
    words = text.translate(table).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(sequence_hashes(word_hashes(words, memo), min(n, len(words))))


def size_class(n: int, percent: int) -> int:
    """Sets that link are in the same class or in neighbouring ones."""
    return math.floor(math.log(n) / max(1e-3, 1.0001 * math.log(100 / percent)))


@cache
def largest_of(c: int, percent: int) -> int:
    """The largest size of a class; 0 if none is in it or below."""
    n = max(1, math.floor(math.exp((c + 1) * max(1e-3, 1.0001 * math.log(100 / percent)))) + 2)
    while n and size_class(n, percent) > c:
        n -= 1
    return n


@cache
def segments(c: int, percent: int) -> tuple[int, int, int]:
    """(most, m, spare) for two sets that link, of which the smaller is in class c: they differ in `most` shingles at most, so of m segments, one for each difference and spare + 1 more, they agree in more than spare."""
    most = largest_of(c, percent) * (100 - percent) // percent
    each = (100 + percent) * percent / (200 * max(100 - percent, 1))  # shingles for each difference in a set of the class's middle size
    spare = 1 + int(most * (0.02 + 2.5 * (1 + each) * math.exp(-each)))  # more than the segments that hold one shingle or none
    return most, most + 1 + spare, spare


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    h = (x ^ np.uint64(by * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@cache
def more_of_prefix(c: int, percent: int) -> int:
    """By how much prefixes in class c are longer than a link needs, so that two sets that link share one more shingle than this in them; every link's overlap is larger."""
    least = largest_of(c - 1, percent) + 1
    return max(0, min(1 + segments(c, percent)[0] // 4, -(-percent * least // 100) - 1))


def marked_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which any two different sets that link share one, whatever their sizes, and the mark of each.

    A set offers keys to its own size class and to the one below, in which it meets smaller sets. For
    a class, the shingles are dealt by hash into so many segments that two sets that link agree in
    more of them than spare; a key is what one segment holds. Segments of one shingle say little: a set
    that has no more than spare of those and empty ones leaves them out, as it agrees with each of its
    links in a larger one. Empty segments say nothing: a set with more than spare of them offers the
    shingles of its prefix too (its first by hash, of which two sets that link share one); so do all
    sets where segments would hold hardly anything.

    A mark holds the class, the kind of key and how many keys of that kind the set may leave out if
    all sets leave out the first in one order: of the segments in which two sets that link agree, more
    than spare, either can only miss the first spare, so both keep the last. Empty segments come first
    in that order, those of one shingle next, and within them the most frequent keys.
    """
    own, out, marks = size_class(len(s), percent), [], []

    def offer(keys: np.ndarray, c: int, kind: int, most: int):
        out.append(keys)
        marks.append(np.full(len(keys), (c * 3 + kind + 3) * MARK_SPARE + most, np.int64))

    for c in (own, own - 1):
        most, m, spare = segments(c, percent)
        if not most:
            continue  # only equal sets link
        few = 2 * m > largest_of(c, percent)
        if not few:
            h = mixed(s, 3)
            at = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            held, sums = np.bincount(at, minlength=m), np.zeros(m, np.uint64)
            np.add.at(sums, at, h * (h | np.uint64(1)))
            keys = lambda full: mixed(sums[full] + full.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), 2 * c + 8)  # noqa: B023, E731
            several, single = np.flatnonzero(held > 1), np.flatnonzero(held == 1)
            empty = m - len(several) - len(single)
            few = empty > spare
            if m - len(several) <= spare:
                offer(keys(several), c, 0, spare - empty - len(single))
            else:
                offer(keys(several), c, 0, 0)
                offer(keys(single), c, 1, max(0, spare - empty))
        if few:
            least, more = -(-percent * len(s) // 100), more_of_prefix(c, percent)
            offer(mixed(np.sort(mixed(s, 5))[: len(s) - least + 1 + more], 2 * c + 9), c, 2, more)
    return (np.concatenate(out), np.concatenate(marks)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def meeting_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys of marked_keys() alone."""
    return marked_keys(s, percent)[0]


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def t_occurrence(sets: list[np.ndarray], percent: int, joined, queries: range | None = None):
    """Yields links (i, j), i < j, until joined(i, j) says that no more of the pair's kind is needed.

    Sets are searched in turn, by size, in inverted lists of the sets before them. A set of n
    shingles links only with sets that share T = ceil(percent n / 100) or more of its shingles, so
    T - 1 of its lists, the longest, can be left out of the merge (DivideSkip): the n - T + 1 short
    ones are heap-merged, and each set found there is looked up in the long ones by binary search,
    as long as the required overlap can still be reached. Pairs that joined() already has are
    skipped, so that a group of copies costs a link for each member and not one for each pair.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    lists: dict[int, list[int]] = {}
    # A shingle of one set alone is in no overlap and needs no list.
    every, times = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    several = every[times > 1]
    for at, i in enumerate(order):
        s, n = sets[i], len(sets[i])
        tokens = s[np.isin(s, several, assume_unique=True)].tolist()
        if queries is None or i in queries:
            own = sorted((x for x in (lists.get(t) for t in tokens) if x), key=len)
            floor = -(-percent * n // 100)  # a smaller set has this share of n at least, and all of it counts
            if len(own) >= floor:
                long_ = min(floor - 1, len(own) - 1)
                short, rest = own[: len(own) - long_], own[len(own) - long_ :]
                found = [(x, sum(1 for _ in run)) for x, run in groupby(heapq.merge(*short))]
                for x, c in sorted(found, key=lambda v: -v[1]):
                    j = order[x]
                    m = len(sets[j])
                    if 100 * m < percent * n or joined(i, j):
                        continue
                    need = -(-percent * (n + m) // (100 + percent))
                    left = len(rest)
                    for other in rest:
                        if c >= need or c + left < need:
                            break
                        k = bisect_left(other, x)
                        c += k < len(other) and other[k] == x
                        left -= 1
                    if c >= need:
                        yield i, j
        for t in tokens:
            lists.setdefault(t, []).append(at)


class Unions:
    """Union-find over indices; the smaller label leads."""

    def __init__(self, labels: list[int]):
        self.label, self.parent = labels, list(range(len(labels)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def same(self, i: int, j: int) -> bool:
        return self.find(i) == self.find(j)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if self.label[b] < self.label[a]:
            a, b = b, a
        self.parent[b] = a


#: Classes that a task remembers to offer their keys once.
SEEN_CLASSES = 1 << 20


def _class_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, equal for equal sets."""
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce((s * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (s >> np.uint64(32))) ^ np.uint64(len(s))), int(np.add.reduce(s * (s | np.uint64(1))))


def _class_number(s: np.ndarray, h1: int, h2: int) -> int:
    """One number of a class, for its keys. Two classes that share one only meet."""
    return (h1 * 0x9E3779B97F4A7C15 + h2 * 0xC2B2AE3D27D4EB4F + len(s)) & 0xFFFFFFFFFFFFFFFF


#: Bits of the sieve of document ids; more ids only let more texts through.
SIEVE_BITS = 1 << 25


def sieved(rows: DataFrame, ids: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """rows without most of those whose key is none of ids (a column of the same name): a Bloom filter of so many bits at most, whatever the corpus.

    A join with ids must follow; it then deals out few rows that find nothing.
    """
    places = lambda: [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(2)]
    words = ids.select(F.explode(F.array(*places())).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("b")).toPandas()
    table = np.zeros(-(-bits // 64), np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for p in (a.to_numpy(), b.to_numpy()):
            out &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(out)

    return rows.where(held(*places()))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Words are runs without white space, A-Z lowered. A document's set holds its distinct shingles of
    so many words (the whole sequence, if shorter). Documents link when 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links lead to, its own included.

    Equal sets become one class, whose documents are linked without comparing. Classes that share a
    meeting key (one segment of their shingles is the same, see marked_keys) in a size class are brought
    together, frequent keys left out as far as no link is lost, so none is missed at any size; their groups are searched exactly by
    t_occurrence() in one task each, or block against block if they have more than block_sets
    classes or block_shingles shingles. Links are kept only as far as they join components, so no
    group emits its pairs, and components are sought among classes, so no copies enter them.

    Null and empty texts, and texts of white space, have no shingles, link with nothing and are their
    own component. A null key keeps a null component and takes no part. Rows that share a key share
    the links of all their texts. Other columns are not returned. Empty table: empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))

    @tidy
    def shingled(items):
        memo: dict = {}
        for batch in batches(items):
            sets = [shingles(x, shingle, memo) for x in utf8(batch.column(1))]
            names, other = (list(x) for x in zip(*map(_class_hashes, sets), strict=True))
            at = [_class_number(s, a, b) for s, a, b in zip(sets, names, other, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "h1": signed(names), "h2": signed(other), "at": signed(at)})

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    sized = checkpointed(slim.mapInArrow(shingled, "doc_id long, n_shingles long, h1 long, h2 long, at long"))

    @tidy
    def keyed(items):
        memo: dict = {}
        seen: set[int] = set()  # classes whose keys this task has offered; forgetting some costs rows alone
        for batch in batches(items):
            ids, keys, marks = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if i is None or not len(s := shingles(x, shingle, memo)):
                    continue
                if (at := _class_number(s, *_class_hashes(s))) in seen:
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(at)
                offered, marked = marked_keys(s, percent)
                keys.append(offered.view(np.int64))
                marks.append(marked)
                ids.append(np.full(len(offered), at, np.uint64).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.concatenate(keys)), "c": pa.array(np.concatenate(ids)), "mark": pa.array(np.concatenate(marks))})

    real = sized.where("n_shingles > 0 and doc_id is not null")
    classes = checkpointed(real.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("most"), F.first("at").alias("at")))
    # One text stands for each class: the row of its smallest key. A class has one number, so texts need not be moved to meet.
    numbers = classes.select("at", "c", "n_shingles")
    # Keys are dealt once: their sums and the join with them read the same exchange. A set has one row for each
    # of its keys, so a key that many sets share is still a small part of the rows, and they stream past it.
    dealt = slim.mapInArrow(keyed, "k long, c long, mark long").where("k is not null and c is not null and mark is not null").repartition("k")
    # The aggregate names every column and nulls are gone before, as it reads the join's exchange only if that is the same.
    shared = dealt.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min("mark").alias("mark"), F.count(F.lit(1)).alias("n")).where("least <> most and mark >= 0").select("k", "n")
    hits = dealt.join(shared, "k").select("k", "c", "mark", "n").distinct()
    # A phrase that many texts hold would chain them all: a set leaves out its most frequent keys, as many as its mark allows.
    first = Window.partitionBy("c", "mark").orderBy(F.desc("n"), "k")
    kept = hits.withColumn("i", F.row_number().over(first)).where(F.col("i") > F.col("mark") % MARK_SPARE)
    kept = stored(kept.select("k", "c", F.floor(F.col("mark") / (3 * MARK_SPARE)).cast("int").alias("class")))
    # A set is one node in each of its two classes, or sets of all sizes would chain.
    node = lambda c: F.xxhash64(c, "class")
    least = kept.groupBy("k", "class").agg(F.min("c").alias("least"))
    met = stored(kept.join(least, ["k", "class"]).where("c <> least").select("c", "least", "class").distinct())
    nodes = met.select(node("c").alias("node"), F.col("c").alias("at")).union(met.select(node("least"), "least")).distinct()
    found = connected_components(met.select(node("c").alias("a"), node("least").alias("b"))).withColumnRenamed("component", "g").join(nodes, "node").join(numbers, "at")
    groups = stored(found.groupBy("c", "g").agg(F.max("n_shingles").alias("n_shingles")))  # a key with several texts may have several classes
    # A component is searched in parts of about a block at most.
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))
    placed = hub_join(groups.select("c", "g"), sizes, "g", groups.count()).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    # A set goes to every pair of parts that has its own part in it.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("p"), F.greatest(o, "part").alias("q")))
    placed = placed.withColumn("pair", F.explode(pairs)).select("g", "c", "part", "pair.p", "pair.q")

    def searched(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p, q, large = key_[1].as_py(), key_[2].as_py(), table.nbytes > LARGE_GROUP
        table = table.sort_by([("c", "ascending")])
        labels, part = table.column("c").to_pylist(), table.column("part").to_pylist()
        memo: dict = {}
        sets = [shingles(x, shingle, memo) for x in utf8(table.column("t").combine_chunks())]
        unions, out = Unions(labels), []
        known = (lambda i, j: part[i] == part[j] or unions.same(i, j)) if p != q else unions.same
        for i, j in t_occurrence(sets, percent, known):
            unions.join(i, j)
            out.append((labels[i], labels[j]))
        if large:
            del table, sets, memo
            release()
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    # Few texts are in a group, so the others are not dealt out to meet their places.
    block = sieved(slim, groups.select(F.col("c").alias("doc_id")), "doc_id").join(placed, F.col("doc_id") == F.col("c")).select("g", "p", "q", "c", "part", "t")
    links = block.groupBy("g", "p", "q").applyInArrow(searched, "a long, b long")
    # The classes of each key; a key whose rows have several texts links their classes.
    copies = classes.where("most <> c").join(real, ["n_shingles", "h1", "h2"]).select("doc_id", "c")
    members = checkpointed(copies.union(classes.where("most = c").select(F.col("c").alias("doc_id"), "c")).distinct())
    first = members.groupBy("doc_id").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    several = members.join(first.where("least <> most"), "doc_id").select(F.col("c").alias("a"), F.col("least").alias("b"))
    found = connected_components(links.union(several)).withColumnRenamed("node", "least")
    known = first.join(found, "least", "left").select("doc_id", F.coalesce("component", "least").alias("component_id"))
    return sized.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
