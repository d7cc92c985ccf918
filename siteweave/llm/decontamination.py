"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import appended, batches, fresh, lowered_words_table, prepare, tidy, utf8, with_schema

#: Test windows that one pass holds; more are searched in further passes.
BLOCK_WINDOWS = 500_000


def words_of(text: bytes, _table: bytes = lowered_words_table()) -> list[bytes]:
    return text.translate(_table).split()


class WuManber:
    """Finds word windows of at least least words in sequences of words.

    A block is two words (one, if least is 1). shift says how far the search may move when a block
    ends at the current word; blocks that end some window's first least words lead to the bucket of
    those windows, a dictionary for each length: a hash of the words picks one, whose words are then compared.
    """

    def __init__(self, windows: dict[tuple, set], least: int):
        self.least, self.block = least, min(2, least)
        self.free = least - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in windows.items():
            for end in range(self.block, least + 1):
                b = words[end - self.block : end]
                move = least - end
                if move < self.shift.get(b, self.free):
                    self.shift[b] = move
                if move == 0:
                    self.bucket.setdefault(b, {}).setdefault(len(words), {})[words] = items

    def search(self, words: list[bytes]):
        """(first word, word after the last, items) of every occurrence."""
        shift, free, block, least, end, n = self.shift.get, self.free, self.block, self.least, self.least, len(words)
        while end <= n:
            b = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            move = shift(b, free)
            if move:
                end += move
                continue
            first = end - least
            for size, windows in self.bucket[b].items():
                if (items := windows.get(tuple(words[first : first + size]))) is not None:
                    yield first, first + size, items
            end += 1


def searchers(items: list[tuple[int, bytes]], window: int) -> list[WuManber]:
    """One for whole windows, one for the items that are shorter."""
    whole: dict[tuple, set] = {}
    short: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        if len(words) < window:
            if words:
                short.setdefault(tuple(words), set()).add(item)
            continue
        for i in range(len(words) - window + 1):
            whole.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = [WuManber(whole, window)] if whole else []
    if short:
        out.append(WuManber(short, min(map(len, short))))
    return out


_BUILT: dict[str, list[WuManber]] = {}


def built(name: str, items: list[tuple[int, bytes]], window: int) -> list[WuManber]:
    """searchers(), built once in each worker process for the pass of this name; those of other passes are let go."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = searchers(items, window)
    return _BUILT[name]


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs (or its columns in keep) with n_words, spans and items.

    Words are runs of letters and digits with A-Z lowered (any character beyond ASCII is a letter).
    A window is so many consecutive words of one item; an item of fewer words is one window. spans
    are the runs of a document's words that lie inside any occurrence of a window, as (first, after);
    items are the ids of the items with an occurrence, each once, ascending.

    Documents are scanned where they lie, nothing is shuffled. The test set goes to the tasks in
    blocks of at most block_windows windows (a single longer item is a block): each block is a
    pass, checkpointed before the next, that adds to what the passes before it have found.

    Null and empty texts have no words; null items and items without words match nothing, a null
    item_id is not reported. Rows repeat as in docs. Columns of the result's names are replaced.
    Empty tables give an empty result, or documents without spans.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))
    bench = benchmark.select(F.col(item).cast("long").alias("i"), F.encode(F.col(item_text), "UTF-8").alias("t")).where("i is not null and t is not null")
    n_windows = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(n_windows) // block_windows))
    given = keep if keep is not None else [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    found = {"n_words": "bigint", "spans": "array<struct<first:bigint,after:bigint>>", "items": "array<bigint>"}
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    out = docs.select(*dict.fromkeys([*given, text]))
    for k in range(blocks):
        mine = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in mine.toLocalIterator()])
        last, name = k == blocks - 1, fresh("pass")

        @tidy
        def scanned(items, k=k, shared=shared, last=last, name=name):
            search = built(name, shared.value, window)
            for batch in batches(items):
                n, spans, names = [], [], []
                old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if k else None
                for x in utf8(batch.column(text)):
                    words = words_of(x)
                    runs, seen = [], set()
                    if old:
                        a, b = next(old)
                        runs, seen = [(s["first"], s["after"]) for s in a], set(b)
                    for s in search:
                        for first, after, who in s.search(words):
                            runs.append((first, after))
                            seen |= who
                    n.append(len(words))
                    spans.append(_joined(runs))
                    names.append(sorted(seen))
                got = appended(batch, {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, span_type), "items": pa.array(names, pa.list_(pa.int64()))})
                yield got.select([*given, *found]) if last else got

        out = out.mapInArrow(scanned, with_schema(out.select(*given) if last else out, found))
        if not last:
            out = checkpointed(out)
    return out


def _joined(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for first, after in sorted(runs):
        if out and first <= out[-1]["after"]:
            out[-1]["after"] = max(after, out[-1]["after"])
        else:
            out.append({"first": first, "after": after})
    return out
