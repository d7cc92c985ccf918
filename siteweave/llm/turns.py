"""Repair of conversations: faults of turns, and the cheapest edits that give their roles a legal order."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, prepare

#: Legal orders of role initials are (s?(ua)+)?. States: at the start, after s, after u, after a. An end is legal in the first and the last.
STATES, ENDS = 4, (0, 3)
#: The state after a user or assistant turn, of which each state allows one.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: The cost of a state that can't be reached; differences of others are far below.
FAR = 1 << 30
#: Edits by their initials, in the order of ties.
EDITS = "DIKR"
#: Bytes of a conversation's turns, and of its backpointers, that stay in memory; what is longer goes to a temporary file of the task.
SPILL = 8 << 20
#: Digests of turns seen that stay in memory as a set; more go to sorted files.
SEEN = 1 << 20
#: Backpointers read at once.
BLOCK = 1 << 16
SPACE = " \t\n\v\f\r"


def with_inserts(costs: list[int]) -> list[int]:
    """The least cost of each state if turns may be inserted."""
    out = list(costs)
    for _ in range(2):
        for q in range(STATES):
            out[NEXT[q]] = min(out[NEXT[q]], out[q] + INSERT)
    return out


@cache
def step(costs: tuple[int, ...], kind: str, bound: bool, truncated: bool) -> tuple[tuple[int, ...], int, int]:
    """(costs after a turn, what they are above, edits that are tight) from the costs of each state before it, inserts included both times.

    kind is the initial of the turn's role (any other than s, u and a may not be kept); bound: it has to be deleted.
    The tight edits are bit 4 * e + q for edit EDITS[e] in state q: those on a cheapest way to the state that they lead to.
    """
    edges = [(0, q, q, costs[q] + DELETE) for q in range(STATES)]
    if not bound:
        for q in range(STATES):
            kept = 1 if kind == "s" and q == 0 else NEXT[q] if kind == {2: "u", 3: "a"}[NEXT[q]] else None
            if kept is not None:
                edges.append((2, q, kept, costs[q] + TRUNCATED * truncated))
            edges.append((3, q, NEXT[q], costs[q] + REROLE + TRUNCATED * truncated))
    after = with_inserts([min((c for _, _, to, c in edges if to == q), default=FAR) for q in range(STATES)])
    tight = sum(1 << (4 * e + q) for e, q, to, c in edges if c == after[to] and c < FAR)
    tight |= sum(1 << (4 + q) for q in range(STATES) if costs[q] < FAR and costs[q] + INSERT == costs[NEXT[q]])
    least = min(after)
    return tuple(min(c - least, FAR) if c < FAR else FAR for c in after), least, tight


@cache
def choose(tight: int, kind: str, good: int) -> tuple[int, int]:
    """(choices, good states before the turn): for each state that leads by tight edits to one that is good after it, the first such edit in the order of ties, as 2 bits."""
    leads = lambda e, q: q if e == 0 else 1 if e == 2 and kind == "s" else NEXT[q]
    chosen = {}
    for _ in range(3):  # inserts lead to states before the same turn
        for q in range(STATES):
            able = [e for e in range(4) if tight >> (4 * e + q) & 1 and (NEXT[q] in chosen if e == 1 else good >> leads(e, q) & 1)]
            if able:
                chosen[q] = able[0]
    return sum(e << (2 * q) for q, e in chosen.items()), sum(1 << q for q in chosen)


class Seen:
    """A set of digests in bounded memory: sorted runs in files beyond SEEN of them."""

    def __init__(self):
        self.now: set[bytes] = set()
        self.runs: list[np.ndarray] = []

    def add(self, digest: bytes) -> bool:
        """Whether the digest was there already."""
        if digest in self.now:
            return True
        for run in self.runs:
            i = int(np.searchsorted(run, np.bytes_(digest)))
            if i < len(run) and run[i] == np.bytes_(digest):
                return True
        self.now.add(digest)
        if len(self.now) >= SEEN:
            with tempfile.TemporaryFile() as f:
                run = np.memmap(f, "S16", "w+", shape=len(self.now))
                run[:] = np.sort(np.array(list(self.now), "S16"))
            self.runs.append(run)
            self.now = set()
        return False


class Conversation:
    """One conversation as its turns stream past; compact backpointers and turns are kept, in a file when they have grown."""

    def __init__(self, key):
        self.key, self.n = key, 0
        self.least = self.most = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.base = 0
        self.before, self.costs, self.seen = None, tuple(with_inserts([0, FAR, FAR, FAR])), Seen()
        self.marks, self.rows = tempfile.SpooledTemporaryFile(SPILL), tempfile.SpooledTemporaryFile(SPILL)  # noqa: SIM115

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
        initial = role[:1]
        self.illegal += self.n > 0 and f"{self.before}{initial}" not in ("su", "ua", "au")
        self.before = initial
        body, name = text.encode("utf-8", "surrogatepass"), role.encode("utf-8", "surrogatepass")
        said = text.rstrip(SPACE)
        again = self.seen.add(hashlib.blake2b(len(name).to_bytes(8, "little") + name + body, digest_size=16).digest())
        bound = truncated = False
        if not said:
            self.blank, bound = self.blank + 1, True
        elif again:
            self.duplicate, bound = self.duplicate + 1, True
        elif said[-1] not in ".!?":
            self.truncated, truncated = self.truncated + 1, True
        kind = initial if initial in ("s", "u", "a") else "-"
        self.costs, more, tight = step(self.costs, kind, bound, truncated)
        self.base += more
        self.marks.write(tight.to_bytes(2, "little") + kind.encode())
        self.rows.write(len(name).to_bytes(4, "little") + len(body).to_bytes(8, "little") + name + body)
        self.n += 1

    def _choices(self) -> int:
        """Writes the choices in place of the backpointers, from the last turn to the first; returns the cost."""
        final = self.costs
        cost = min(final[q] for q in ENDS)
        ends = {q for q in ENDS if final[q] == cost}
        for _ in range(2):
            ends |= {q for q in range(STATES) if NEXT[q] in ends and final[q] + INSERT == final[NEXT[q]]}
        self.tail, good = {q: cost - final[q] for q in ends}, sum(1 << q for q in ends)
        for first in range((self.n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            self.marks.seek(first * 3)
            block = bytearray(self.marks.read(min(BLOCK, self.n - first) * 3))
            for i in range(len(block) - 3, -1, -3):
                block[i], good = choose(block[i] | block[i + 1] << 8, chr(block[i + 2]), good)
            self.marks.seek(first * 3)
            self.marks.write(block)
        return self.base + cost

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the cheapest edits in order; a deleted turn has its old role and text. Sets cost first."""
        self.cost = self._choices()
        self.rows.seek(0)
        state = 0
        for first in range(0, self.n, BLOCK):
            self.marks.seek(first * 3)
            block = self.marks.read(min(BLOCK, self.n - first) * 3)
            for i in range(0, len(block), 3):
                while (e := block[i] >> (2 * state) & 3) == 1:
                    state = NEXT[state]
                    yield "I", ROLE[state], ""
                head = self.rows.read(12)
                name = self.rows.read(int.from_bytes(head[:4], "little")).decode("utf-8", "surrogatepass")
                body = self.rows.read(int.from_bytes(head[4:], "little")).decode("utf-8", "surrogatepass")
                if e == 2:
                    state = 1 if block[i + 2] == ord("s") else NEXT[state]
                elif e == 3:
                    state = NEXT[state]
                    name = ROLE[state]
                yield EDITS[e], name, body
        while state not in ENDS or self.tail[state]:
            state = NEXT[state]
            yield "I", ROLE[state], ""

    def close(self) -> None:
        self.marks.close()
        self.rows.close()


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id bigint, place bigint, role string, text string, edit string"


def _conversations(items, made):
    """made(conversation) of each conversation, of rows that come sorted by conversation and turn."""
    now = None
    for batch in batches(items):
        for key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield from made(now)
                    now.close()
                now = Conversation(key)
            now.add(turn, role, text)
    if now is not None:
        yield from made(now)
        now.close()


def _sorted(turns: DataFrame) -> DataFrame:
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair_report(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text): its faults, its cheapest edits and a digest of what they give.

    Rows are taken by turn (nulls first; ties by role and text), null roles and texts as one space.
    gaps are the turn numbers missing between the least and the most. A row's first fault counts: blank
    (no character but white space), duplicate (role and text seen earlier), truncated (its last
    character that is no white space ends no sentence). illegal counts neighbours whose role
    initials are not su, ua or au. Keeping a turn costs 0, another role 2, deleting 3 (blank and
    duplicate turns have to go), inserting an empty turn 2; a truncated turn that stays adds 1. audit
    has the initials of the cheapest edits that give role initials (s?(ua)+)?, the first of equals in
    ASCII; repaired_sha256 is of the repaired `role:text`, joined by newlines.

    Conversations are dealt by conv_id and sorted by turn; a task streams through them with four costs
    and, for each turn, three bytes of backpointers. Those and the turns of a conversation beyond SPILL bytes
    lie in a file of the task that is gone when the task ends, as a lost task starts anew. A null conv_id is
    a conversation of its own; no rows, no result.
    """

    def report(now: Conversation):
        audit, digest, some = bytearray(), hashlib.sha256(), False
        for edit, role, text in now.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update(("\n" * some + role + ":" + text).encode("utf-8", "replace"))
                some = True
        gaps = 0 if now.most is None else now.most - now.least + 1 - now.turns
        yield now.key, gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.cost, audit.decode(), digest.hexdigest()

    return _sorted(turns).mapInArrow(_rows(report, REPORT), REPORT)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that the cheapest edits of repair_report() leave or insert, place from 0; edit is its initial."""

    def kept(now: Conversation):
        place = 0
        for edit, role, text in now.edits():
            if edit != "D":
                yield now.key, place, role, text, edit
                place += 1

    return _sorted(turns).mapInArrow(_rows(kept, REPAIRED), REPAIRED)


def _rows(made, ddl: str, most: int = 2000, most_bytes: int = 16 << 20):
    """An Arrow stage that yields the tuples of made(conversation) in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def stage(items):
        rows, size = [], 0
        for row in _conversations(items, made):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= most or size >= most_bytes:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return stage
