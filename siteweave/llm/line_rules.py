"""Quality rules for documents: rules on each text, and lines that too many documents of a host share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hub_join
from ..session import stored
from .common import appended, batches, fresh, lowered_spaces_table, prepare, sequence_hashes, utf8, with_schema

#: A line is common if more documents of its host than this have it, and more than COMMON_PERCENT of them.
COMMON_DOCS, COMMON_PERCENT = 20, 1
#: A document is depleted if it has fewer words left than this, or less than LEFT_PERCENT of its words.
LEFT_WORDS, LEFT_PERCENT = 20, 50
#: Words of the windows that count as repeated, least words of a document, and most of its words in repeated windows.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30

_SYMBOLS = bytes(b"#*$%&|<>")
_DIGITS = re.compile(rb"[0-9]+")
_LOWER = lowered_spaces_table()


def normal_line(line: bytes) -> bytes:
    """A-Z lowered, runs of digits as one 0, white space as single spaces, none at the ends."""
    return b" ".join(_DIGITS.sub(b"0", line.translate(_LOWER)).split())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more in the text. The process's own 64-bit hashes do, as they stay in one text."""
    if len(words) <= window:
        return 0
    h = sequence_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), window)
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    hit = np.isin(h, again)
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:-window][hit] += 1
    covered[window:][hit] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (all but the text, if not given) with what one text shows by itself.

    __row numbers the rows; __host is a hash of the host; n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words as counts; __lines and __line_words are the hashes of the different normalised
    lines and the words of each, repeats included. Stored, so that the numbers stay.
    """
    import xxhash
    from pyspark import TaskContext

    prepare(docs.sparkSession)
    given = keep if keep is not None else [c for c in docs.columns if c != text]
    own = "__row bigint, __host bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, __lines array<bigint>, __line_words array<bigint>"
    kinds = {"__lines": pa.list_(pa.int64()), "__line_words": pa.list_(pa.int64())}

    def measured(items):
        number = TaskContext.get().partitionId() << 40
        for batch in batches(items):
            out = {c.split()[0]: [] for c in own.split(", ")}
            for h, t in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                words = t.split()
                lines: dict[int, int] = {}
                seen, again = set(), 0
                for line in t.split(b"\n"):
                    if not (n := len(line.split())):
                        continue
                    again += line in seen
                    seen.add(line)
                    at = xxhash.xxh3_64_intdigest(normal_line(line)) - (1 << 63)
                    lines[at] = lines.get(at, 0) + n
                chars = sum(map(len, words))
                if not t.isascii():
                    chars -= sum(0x80 <= b < 0xC0 for b in t) if len(t) < 64 else int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80))
                row = (number, xxhash.xxh3_64_intdigest(h) - (1 << 63), len(words), chars, len(t) - len(t.translate(None, _SYMBOLS)), again, repeated_words(words), list(lines), list(lines.values()))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                number += 1
            made = [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*(f"c{i}" for i in range(len(given))), *out])

    named = docs.select(F.col(f"`{host}`").cast("string").alias("h"), F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)])
    schema = ", ".join([*(f"c{i} {named.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(given))), own])
    return stored(named.mapInArrow(measured, schema)).toDF(*given, *(c.split()[0] for c in own.split(", ")))


def common_lines(measured: DataFrame, docs_limit: int = COMMON_DOCS, percent: int = COMMON_PERCENT) -> DataFrame:
    """(__host, line, n): lines in more than docs_limit documents of their host and more than percent of its documents."""
    lines = measured.select("__host", F.explode("__lines").alias("line"))
    often = lines.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > docs_limit)
    hosts = measured.groupBy("__host").agg(F.count(F.lit(1)).alias("__docs")).where(F.col("__docs") > docs_limit)
    return often.join(hosts, "__host").where(F.col("n") * 100 > F.col("__docs") * percent).drop("__docs")


def without_lines(rows: DataFrame, text: str, removed: str, out: str) -> DataFrame:
    """rows with out: the text without the lines whose hashes are in the array removed (null: none); a null text stays null."""
    import xxhash

    def cleaned(items):
        for batch in batches(items):
            texts = []
            for t, gone in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(removed).to_pylist(), strict=True):
                if t is not None and gone:
                    gone = set(gone)
                    t = b"\n".join(x for x in t.split(b"\n") if not x.split() or xxhash.xxh3_64_intdigest(normal_line(x)) - (1 << 63) not in gone)
                texts.append(t)
            yield appended(batch, {out: pa.array(texts, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(cleaned, with_schema(rows, {out: "string"}))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, docs_limit: int = COMMON_DOCS, percent: int = COMMON_PERCENT, clean: bool = False) -> DataFrame:
    """docs' columns in keep (all but the text) with the counts of measure(), n_common_words, base_failed and kept.

    Every row of docs is one document. Lines are compared normalised (normal_line) by a 64-bit hash. A
    line that is common at its host is removed: n_common_words are the words of the removed lines. A
    document is kept unless the rules on its own text fail (base_failed) or it is depleted. Words are
    runs of anything but the six ASCII white-space characters.

    Texts are read once and never shuffled; a line crosses the network as two hashes and its words.
    The lines of a host are spread by their hash, documents of a line are counted in the tasks first,
    and a line with a large share of all documents is joined where its rows lie. clean adds clean_text,
    the text without its common lines; only then do texts cross the network, once.

    Null and empty texts have no words and fail. A null host is a host of its own, as is an empty one. Repeated
    rows are so many documents. Input columns of the result's names are replaced. No rows, no result.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept", *(["clean_text"] if clean else []))
    given = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in made]
    at = {c: fresh(c) for c in (*given, host, text)}
    null = F.when(F.col(f"`{host}`").isNull(), "null").otherwise(F.concat(F.lit("host "), F.col(f"`{host}`").cast("string")))
    named = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in given if c != host], F.col(f"`{text}`").alias(at[text]), F.col(f"`{host}`").alias(at[host]), null.alias("__of"))
    rows = measure(named, "__of", at[text], [at[c] for c in given] + [at[text]] * clean)
    lines = rows.select("__row", "__host", F.explode(F.arrays_zip("__lines", "__line_words")).alias("l")).select("__row", F.xxhash64("__host", "l.__lines").alias("line"), F.col("l.__lines").alias("hash"), F.col("l.__line_words").alias("words"))
    common = stored(common_lines(rows, docs_limit, percent).select(F.xxhash64("__host", "line").alias("line"), "n"))
    gone = [F.collect_list("hash").alias("__gone")] if clean else []  # of one document's lines
    removed = hub_join(lines if clean else lines.drop("hash"), common, "line", rows.count()).groupBy("__row").agg(F.sum("words").alias("n_common_words"), *gone)
    out = rows.drop("__lines", "__line_words", "__host").join(removed, "__row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    if clean:
        out = without_lines(out, at[text], "__gone", "clean_text")
    left = F.col("n_words") - F.col("n_common_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= LEFT_WORDS) & (left * 100 >= F.col("n_words") * LEFT_PERCENT))
    return out.select(*[F.col(at[c]).alias(c) for c in given], *made)
