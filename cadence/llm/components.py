"""Connected components of links that no single task holds.

Each task first unites its own links (union-find, path halving), so a dense group sends one link per
node. What is left is dealt to as few tasks as TASK_LINKS allows, which unite it once more. Then stars are
contracted over the whole table: all larger neighbours of a node are linked to its least neighbour, then all
smaller ones, until every node hangs on the root of its component. Each round is written to the checkpoint
folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget

LINK = "child long, parent long"
#: Links that a task unites at once: this bounds its memory, at any number of links.
TASK_LINKS = 1_000_000


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, root) for each node that is not the least of its component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(where[: len(a)].tolist(), where[len(a) :].tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    child, parent = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        child, parent = unite(np.concatenate([child, b.column(0).to_numpy()]), np.concatenate([parent, b.column(1).to_numpy()]))
        if len(child) > TASK_LINKS:  # what is united so far leaves the task
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["child", "parent"])
            child, parent = child[:0], parent[:0]
    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["child", "parent"])


def components(links: DataFrame, rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """links(a, b), neither null -> child, parent: each linked node but the least of its component, and that least one."""
    e = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).filter("child > parent")
    own = e.mapInArrow(_local, LINK).checkpoint()
    tasks = max(1, -(-own.count() // task_links))  # no step below adds links
    e = own.coalesce(tasks).mapInArrow(_local, LINK).distinct().coalesce(tasks).checkpoint()
    forget(own)
    for _ in range(rounds):
        state = e.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
        roots = e.select(F.col("parent").alias("p")).distinct()
        if not state.join(roots, F.col("child") == F.col("p"), "left").filter("n > 1 or p is not null").limit(1).count():
            return e
        both = e.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(e.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        low = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(low, "child").filter("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        before, e = e, small.union(low.select("child", F.col("m").alias("parent"))).distinct().coalesce(tasks).checkpoint()
        forget(before)
    raise RuntimeError("components have not settled")
