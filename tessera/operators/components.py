"""Connected components as DataFrame plans: large-star and small-star rounds over an edge table.

Each round is two aggregates and two joins on a table in the shared folder; the number of rounds grows with the logarithm
of the longest path. Hubs are dealt over many tasks. No edge or label comes to the driver, only their counts. Where ``few``
is given and no more edges than that are left, one task settles them: its memory is bounded by that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plumbing import SALTS, over_tasks, removed, skew_join, written

#: Edges that one task settles: two of them are 16 bytes, so that it holds a few tens of MB.
FEW = 1 << 17
#: Edges that a task of a round takes where links are dealt over a number of tasks.
EACH = 1 << 16


def _star(edges: DataFrame, large: bool, total: int, tasks: int | None) -> DataFrame:
    """edges: u > v. large: each neighbour above u goes to u's least neighbour; else each neighbour below u, and u."""
    dealt = lambda df: over_tasks(df, tasks, "u", "v")
    sides = edges.select("u", "v")
    if large:
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if tasks:  # nodes are dealt by their number, each hub's neighbours first over SALTS groups
        salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("s")
        some = over_tasks(sides.select("u", "v", salt), tasks, "u", "s").groupBy("u", "s").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = over_tasks(some, tasks, "u").groupBy("u").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    else:
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.withColumn("m", F.least("u", "m"))
    near = skew_join(sides, least, ["u"], "n", total, F.col("v"), tasks=tasks)
    if large:
        return dealt(near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")).distinct()
    near = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return dealt(near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")).distinct()


def _settled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: every node of the edges but the least of its component, and that least node."""
    held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in it]
    if not held:
        return
    nodes, at = np.unique(np.concatenate(held), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], names=["u", "v"])


def components(links: DataFrame, a: str, b: str, rounds: int = 100, few: int = 0, tasks: int | None = None) -> DataFrame:
    """node, component (its least node) of every node that has a link to another; links in any order and number.

    few: edges that one task may settle, for nodes that are longs; 0 keeps everything in DataFrame plans. tasks: over how many
    links are dealt, in place of the session's number; rounds take a task for each ``EACH`` edges left, that many at most.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")
    edges = over_tasks(edges, tasks, "u", "v").distinct()
    edges = written(edges, "cc-edges")
    count = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    state = count(edges)
    for _ in range(rounds):
        before, old = state, edges
        if state[0] <= few:
            edges = written(edges.coalesce(1).mapInArrow(_settled, "u long, v long"), "cc-edges")
            removed(old)
            break
        total = 1 << state[0].bit_length()  # plans of rounds that differ in nothing but their tables share their code
        each = tasks and max(1, min(tasks, total // EACH))
        large = written(_star(edges, True, 2 * total, each), "cc-large")
        edges = written(_star(large, False, total, each), "cc-edges")
        removed(old, large)
        state = count(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
