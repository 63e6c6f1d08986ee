"""Connected components of an edge table by alternating star contractions.

Each round replaces every node's larger neighbours' edges by edges to the least node around it, first over
all neighbours, then over the smaller ones, until nothing changes: a number of rounds that grows with the
logarithm of the component size, not with its diameter (Kiveris et al., 2014). Every round is written to the
shared folder, so that a lost executor costs one round, and the round before it is deleted. What is left after
a round is settled by one task once it has at most ``in_one_task`` edges (16 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import remove, written

#: Edges that one task settles: 16 MB of them.
IN_ONE_TASK = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum of hashes that the write itself has counted."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("u", "v").cast("long")).alias("b"))
    out = written(told, name)
    return out, tuple(seen.get[x] for x in ("n", "a", "b"))


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of edges in memory: hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[label]
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if ends:
        node, least = least_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", limit: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, component): every node of an edge with the least node of its component.

    Edges with a null end are ignored; loops make their node a component of its own if it has no other edge.
    Ends are integers for in_one_task to hold; edges of other types take the rounds whatever their number.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now, state = _kept(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    whole = {t for _, t in now.dtypes} <= {"bigint", "int", "smallint", "tinyint"}
    kind = dict(now.dtypes)["u"]
    made = [now]
    for _ in range(limit):
        if whole and state[0] <= in_one_task:
            found = now.repartition(1).mapInArrow(_settled, f"node {kind}, component {kind}")
            break
        loops = now.where("u = v")
        after, changed = _kept(_small_star(_large_star(now.where("u <> v"))).unionByName(loops), "stars")
        now, before, state = after, state, changed
        made.append(now)
        if state == before:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).where("node <> component")
            found = found.unionByName(now.where("u <> v").select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            found = found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti"))
            break
    else:
        raise RuntimeError(f"no fixed point after {limit} rounds")
    out = written(found, "components")
    for table in made:
        remove(table)
    return out
