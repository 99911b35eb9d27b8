"""Connected components of links that no single task or driver holds.

Each task first replaces its links by a forest of them (as many components, at
most one link a node), then large-star and small-star rounds run until every
link points to the least node of its component. Minima are taken with partial
aggregates and stored before they are joined back: Spark then knows their size
(it sends small ones to all tasks) and can split the rows of a node with very
many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.shared import stored
from acyclica.llm.workers import lean

#: Nodes that a task's forest remembers; then it starts afresh.
FOREST = 1_000_000


def forest(most: int = FOREST):
    """A function from links (an n x 2 array) to a batch of those that join nodes not joined before in this task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def run(links: np.ndarray) -> pa.RecordBatch:
        if len(parent) > most:
            parent.clear()
        out = []
        for a, b in links.tolist():
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
        kept = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = forest()
    for b in batches:
        yield tree(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("a", "b")
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every linked node: root is the least node of its component. Links are (a, b) longs; repeated ones and loops don't matter."""
    e = stored(links.filter("a <> b").mapInArrow(lean(_contract), "a long, b long"), "links")
    state = None
    for _ in range(max_rounds):
        e = stored(_small_star(_large_star(e)), "stars")
        new = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
