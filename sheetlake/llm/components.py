"""Connected components of a table of links: folded by tasks, what is left in rounds of joins with checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map, release, stored

#: Links that a task folds at once.
STRETCH = 1 << 20


def settled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, sorted, and the smallest node each can reach by them."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != (further := root[root])).any():
            root = further
    return nodes, nodes[root]


def folded(links: DataFrame) -> DataFrame:
    """(node, root) of every node in every stretch of links a task reads: its smallest node there, itself included."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            ends = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
            return pa.record_batch([pa.array(c) for c in settled(*ends)], names=["node", "root"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= STRETCH:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return arrow_map(links.select(F.col("x").cast("long"), F.col("y").cast("long")), fold, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (x, y; longs): root is the smallest node it can reach.

    Tasks fold the links they read; a node has a root from each stretch it is in, and these roots are
    the links of the next, smaller level.  A level that has not shrunk by a quarter (chains across
    tasks) is left to ``rounds``.  A node has as many rows as there are stretches at most, however many
    neighbours it has.  An empty table gives no rows; repeated and one-node links are fine; null ends
    are left out.
    """
    links = links.where("x is not null and y is not null")
    levels, before = [], None
    while True:
        met = folded(links).groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        level = stored(met.withColumn("roots", F.array_except("roots", F.array("root"))))
        nodes, left = level.agg(F.count(F.lit(1)), F.sum(F.size("roots"))).first()
        levels.append(level)
        if not left:
            break
        links = level.select(F.explode("roots").alias("x"), F.col("root").alias("y"))
        if 4 * left > 3 * (nodes if before is None else before):
            levels.append(rounds(links))
            break
        before = left
    found = levels[-1].select("node", "root")
    if len(levels) == 1:
        return found
    for level in reversed(levels[:-1]):
        tops = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = level.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = stored(found)
    for level in levels:
        release(level)
    return found


def rounds(links: DataFrame) -> DataFrame:
    """(node, root) as ``components`` gives it, by joins alone.

    Each round takes the smallest root among a node's neighbours and gives it to all nodes of the node's
    own root, so whole trees merge with their neighbours and rounds grow with the logarithm of a component.  Only minima cross the network: a node with many neighbours is folded before the
    shuffle.
    """
    both = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("root")))
    while True:
        seen = both.join(state.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(
            F.min("root").alias("met")
        )
        merged = state.join(seen, "node").withColumn("least", F.least("root", "met"))
        hooks = merged.groupBy("root").agg(F.min("least").alias("hook"))
        moved = merged.join(hooks, "root").select("node", F.col("hook").alias("root"), (F.col("hook") < F.col("root")).alias("moved"))
        following = stored(moved)
        release(state)
        state = following.select("node", "root")
        if following.where("moved").isEmpty():
            release(both)
            return state
