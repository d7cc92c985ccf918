"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that one Arrow batch brings to a Python worker, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small, as a batch of long texts would otherwise fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(name: str) -> str:
    """A column name that cannot clash with a caller's."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null: empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def texts(array: pa.Array) -> list[str]:
    """The texts of an Arrow column; null: empty. Bytes that are no UTF-8 become replacement characters."""
    try:
        return [x or "" for x in array.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in utf8(array)]


def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (x for x in items if x.num_rows)


def release() -> None:
    """Gives what is free in this process back to the system; the allocators of Arrow and C would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow, with its memory given back at the end: Spark keeps a task's worker for later tasks, and idle ones count against the executor too."""

    @functools.wraps(f)
    def run(items):
        yield from f(items)
        release()

    return run


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns; a column of the same name is replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def with_schema(df: DataFrame, ddl: dict[str, str]) -> StructType:
    """df's columns followed by ddl's, the latter in place of columns of the same name."""
    more = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in ddl.items()))
    return StructType([*(f for f in df.schema.fields if f.name not in ddl), *more.fields])


def word_hashes(words: list[bytes], memo: dict[bytes, int], most: int = 150_000) -> np.ndarray:
    """64-bit hashes of words. The memo only saves time and is emptied when it has grown."""
    import xxhash

    if len(memo) > most:
        memo.clear()
    get, one = memo.get, xxhash.xxh3_64_intdigest
    out = [get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                if (h := get(w)) is None:
                    h = memo[w] = one(w)
                out[i] = h
    return np.array(out, dtype=np.uint64)


def lowered_words_table() -> bytes:
    """A byte table: A-Z lowered, other ASCII that is no digit or letter a space, the rest kept."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def lowered_spaces_table() -> bytes:
    """A byte table: A-Z lowered, the six white-space bytes a space, the rest kept."""
    return bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: Counters in one block of a table of counts.
COUNT_BLOCK = 4096
COUNT_TYPES = "block int, counts binary"


def count_blocks(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers and contents of the blocks of a task's counts that are not all zero."""
    found = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(counts.reshape(-1, COUNT_BLOCK)) if b.any()]
    return [i for i, _ in found], [b for _, b in found]


def summed_counts(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' counts (block, counts), added up by block; size numbers come back, whatever the corpus."""

    @tidy
    def summed(items):
        totals: dict[int, np.ndarray] = {}
        for batch in batches(items):
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(b), np.int64)
                totals[i] = totals[i] + one if i in totals else one
        keys = sorted(totals)
        yield pa.RecordBatch.from_pydict({"block": pa.array(keys, pa.int32()), "counts": pa.array([zlib.compress(totals[k].tobytes(), 1) for k in keys], pa.binary())})

    out = np.zeros(size, np.int64)
    # A task adds up its rows one by one, so a block with a row from every task of a large corpus fits.
    for r in rows.select("block", "counts").repartition(F.col("block")).mapInArrow(summed, COUNT_TYPES).collect():
        out[r["block"] * COUNT_BLOCK : (r["block"] + 1) * COUNT_BLOCK] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out
