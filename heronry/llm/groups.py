"""Connected groups of a graph given as a table of edges (a BIGINT, b BIGINT)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import scratch
from heronry.llm.vectext import components

#: up to this many edges (16 bytes each) one task finds the groups; beyond, rounds of joins do
ONE_TASK_EDGES = 4_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def solve(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = components(len(nodes), flat[: len(a)], flat[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(solve, "node long, root long")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds: every edge is moved to the smallest neighbour until
    each group is a star around its smallest node. The number of rounds grows with the logarithm of the
    longest path."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    now, before = scratch.table(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        now = scratch.table(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): root is the smallest node of the group of node. Nodes without an edge are not listed.
    Self-edges and repeated edges do no harm; an empty table gives an empty one. Both ways give the same."""
    edges = scratch.table(edges.select("a", "b").where("a is not null and b is not null"))
    return _in_one_task(edges) if edges.count() <= one_task_edges else _in_rounds(edges)
