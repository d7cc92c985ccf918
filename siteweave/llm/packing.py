"""Packing of token sequences by first-fit decreasing with a tournament tree."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import batches, prepare, texts, tidy

#: Documents in a group on the average; a group is packed by one task from lengths alone.
GROUP_DOCS = 4096
_BINS = 1 << 32


class Tournament:
    """Room of bins in the leaves, the most room below in every inner node."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes size from the first bin that has the room, and names the bin."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        taken = node
        most[node] -= size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            most[node] = left if left >= right else right
        return taken - self.leaves


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; ties in their given order."""
    tree, filled, out = Tournament(len(sizes), room), {}, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.first_fit(sizes[i])
        out[i] = (k, filled.get(k, 0))
        filled[k] = out[i][1] + sizes[i]
    return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", room: int = 1024, end_id: int = 0, seed: int = 11, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most room ids.

    A document's ids are the vocabulary's for its whole text, then end_id. Each run of room ids is a
    sequence of its own; what is left of a document is one piece, placed by first-fit decreasing
    among the documents of its group, with a tournament tree over the bins' room. Groups are drawn
    by a seeded hash of the key and the text's length and checksum, GROUP_DOCS documents on the
    average, so that no source or kind of text fills a group. Only lengths and checksums are
    shuffled (and the ids themselves with keep_ids).

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary,
    little-endian unsigned 32-bit, with keep_ids). A null or empty text is the one id end_id.
    A null key stays null; rows that repeat are packed as often as they occur. Other columns are
    not returned, so their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    end = end_id.to_bytes(4, "little")
    step = 4 * room

    @tidy
    def encoded(items):
        bpe = byte_bpe(tokenizer)
        for batch in batches(items):
            n, crcs, all_ids = [], [], []
            for x in texts(batch.column(1)):
                ids = bpe.ids(x) + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
                if keep_ids:
                    all_ids.append(ids)
            columns = {"doc_id": batch.column(0), "doc_tokens": pa.array(n, pa.int64()), "crcs": pa.array(crcs, pa.list_(pa.int64()))}
            if keep_ids:
                columns["ids"] = pa.array(all_ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)[key]
    more = ", ids binary" if keep_ids else ""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    known = slim.mapInArrow(encoded, f"doc_id {kind}, doc_tokens bigint, crcs array<bigint>{more}")
    known = known.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "crcs"), F.lit(groups)))

    def placed(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        table = table.sort_by([("doc_tokens", "descending"), ("doc_id", "ascending")])
        tokens, crcs = table.column("doc_tokens").to_pylist(), table.column("crcs").to_pylist()
        rest = [n % room for n in tokens]
        places = iter(first_fit_decreasing([x for x in rest if x], room))
        used, row, start, length, crc, sequence, offset = len(rest), [], [], [], [], [], []
        for i, n in enumerate(tokens):
            for j, at in enumerate(range(0, n, room)):
                size = min(room, n - at)
                if size == room:
                    k, o, used = used, 0, used + 1
                else:
                    k, o = next(places)
                row.append(i)
                start.append(at)
                length.append(size)
                crc.append(crcs[i][j])
                sequence.append(g * _BINS + k)
                offset.append(o)
        own = table.take(pa.array(row, pa.int64()))
        out = {"doc_id": own.column("doc_id"), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": own.column("doc_tokens"), "sequence_id": sequence, "offset": offset}
        if keep_ids:
            ids = table.column("ids").to_pylist()
            out["ids"] = pa.array([ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(row, start, length, strict=True)], pa.binary())
        return pa.table(out)

    return known.groupBy("g").applyInArrow(placed, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{more}")
