"""Connected components of a link table whose groups may hold a third of all nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import places
from .shared import stored


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): for the nodes of the pairs (u, v) that are no root, the smallest node that the pairs connect them with."""
    names, at = places(np.concatenate([u, v]))
    up = list(range(len(names)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u):].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    root = np.fromiter(map(top, range(len(names))), dtype=np.int64, count=len(names))
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


#: Links (16 bytes each) that one task connects by itself; more take the rounds.
LOCAL_LINKS = 1 << 17


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots: ``root`` is the smallest node that links (u, v) lead to. Nodes are BIGINTs without nulls.

    Each batch of links is first cut down to a spanning forest. What is left is counted: LOCAL_LINKS or fewer are connected in one task, a few MB
    whatever the corpus. Of more, a node's neighbours are hung on the smallest of them, those above the
    node first, then those below it, until nothing changes: few rounds whatever the diameter. A hub is one skewed side of a join with one row a
    node, and the minimum for it is taken before the shuffle. No links: no rows.
    """
    low = lambda df: df.groupBy("a").agg(F.min("b").alias("m"))
    current = stored(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).mapInArrow(_shortened, "a long, b long"))
    if current.count() <= LOCAL_LINKS:
        return stored(current.coalesce(1).mapInArrow(_connected, "node long, root long"))
    current = stored(current.distinct())
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    before = current.agg(*mark).first()
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = low(both).select("a", F.least("m", "a").alias("m"))
        above = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        best = low(above)
        below = above.join(best, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(below.unionByName(best.select("a", F.col("m").alias("b"))).distinct())
        after = current.agg(*mark).first()
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
