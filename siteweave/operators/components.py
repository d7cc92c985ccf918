"""Connected components by large-star rounds, with edges contracted in the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .skew import HUB_SHARE, hub_join

#: Nodes that a task holds to contract its edges.
HELD_NODES = 1 << 18


def _stars(parent: dict[int, int]) -> pa.RecordBatch:
    """(u, v) of each node and the smallest one of its tree, if that is another; parents are smaller than their children."""
    for u in sorted(parent):
        parent[u] = parent[parent[u]]
    n = len(parent)
    u, v = np.fromiter(parent.keys(), np.int64, n), np.fromiter(parent.values(), np.int64, n)
    return pa.RecordBatch.from_pydict({"u": pa.array(u[u != v]), "v": pa.array(v[u != v])})


def _joined(edges: DataFrame, most: int) -> DataFrame:
    def run(items):
        parent: dict[int, int] = {}
        last = None

        def find(x: int) -> int:
            top = x
            while (p := parent.setdefault(top, top)) != top:
                top = p
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for batch in items:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if u != last and len(parent) >= most:
                    yield _stars(parent)
                    parent.clear()
                last = u
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            yield _stars(parent)

    return edges.mapInArrow(run, "u long, v long")


def contracted(edges: DataFrame, most: int = HELD_NODES) -> DataFrame:
    """Edges (u, v), u > v, with the components of edges: what a task has joins each node to the smallest one, twice.

    First where the edges lie, so that a node has one row as u from each most nodes of a task, whatever its
    edges; then where the rows of each u have come together.
    """
    return _joined(_joined(edges, most).repartition("u").sortWithinPartitions("u"), most)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Labels the nodes of an undirected edge table with the smallest node of their component.

    Returns (node, component), one row for each node that has an edge to another node. Nulls and
    loops are ignored, repeated edges count once, an empty table gives an empty result. Each round
    joins the larger neighbours of a node to its smallest one (large-star) and contracts what comes
    of it, until all trees are stars. A node's neighbours are reduced by a partial aggregate and a join,
    never gathered into one row, and the edges of a hub are joined where they lie. Every step is
    stored, so that a round's plan holds no other, and lets its exchanges go.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = stored(contracted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.max("v").alias("top"), F.count(F.lit(1)).alias("n")))
        # In a star a node has larger neighbours alone or a single smaller one.
        state = least.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.coalesce(F.bool_or(F.expr("m < u and top <> m")), F.lit(False)).alias("open")).first()
        if not state["open"]:
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        nearest = least.select("u", "m", "n")
        hubs = state["most"] > state["n"] // HUB_SHARE
        large = hub_join(both, nearest, "u", state["n"]) if hubs else both.join(nearest.drop("n"), "u")
        edges = stored(contracted(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
