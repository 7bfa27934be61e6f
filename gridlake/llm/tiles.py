"""Exact comparison of the sets that share a region, in tiles of bounded size; only a spanning forest of the links leaves a tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import places
from .components import connect, forest
from .shared import look_up, stored

#: Sets in the strips of a cell that are compared at once, and distinct shingles of them that one step looks at.
NARROW, WIDE, TILE_TOKENS = 64, 256, 1 << 13


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y, distance, linked) of pairs of sets (x, y): the exact Jaccard distance. ``sets`` is bucketed, so only the pairs move."""
    one = sets.select(F.col("uid").alias("x"), F.col("n").alias("xn"), F.col("shared").alias("xs"))
    two = sets.select(F.col("uid").alias("y"), F.col("n").alias("yn"), F.col("shared").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    met = pairs.join(one, "x").join(two, "y").select("x", "y", both.alias("both"), (F.col("xn") + F.col("yn") - both).alias("all"))
    return met.select("x", "y", (1 - F.col("both") / F.col("all")).alias("distance"), (100 * F.col("both") >= percent * F.col("all")).alias("linked"))


def rooted(df: DataFrame, edges: DataFrame) -> DataFrame:
    """``df`` with ``root``, the smallest set that the links in ``edges`` connect ``uid`` with."""
    group = connect(edges).select(F.col("node").alias("uid"), "root")
    return df.drop("root").join(group, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def opened(regions: DataFrame, key: str) -> DataFrame:
    """``regions`` with ``main``, the component with most sets of the region, and ``open``: whether a set is outside of it. A region of one component goes."""
    parts = regions.groupBy(key, "root").agg(F.count(F.lit(1)).alias("many"))
    main = parts.groupBy(key).agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return look_up(regions, main.drop("roots"), key, "uid").withColumn("open", F.col("root") != F.col("main"))


def cells(regions: DataFrame) -> DataFrame:
    """(cell, uid, root, open): what is compared with each other, and which sets are not in its main component.

    Regions with the same main component make one cell, so that a pair is compared once however many tokens it shares. Where that joins
    so much that its regions one by one are fewer pairs, they stay cells of their own.
    """
    apart = regions.groupBy("main", "token").agg(F.sum(F.col("open").cast("long")).alias("o"), F.count(F.lit(1)).alias("c"))
    apart = apart.groupBy("main").agg(F.sum(F.col("o").cast("double") * F.col("c")).alias("apart"))
    sets = regions.select("main", "uid", "root", "open").distinct()
    cost = sets.groupBy("main").agg(F.sum(F.col("open").cast("long")).alias("o"), F.count(F.lit(1)).alias("c")).join(apart, "main")
    cost = cost.select("main", (F.col("o").cast("double") * F.col("c") > F.col("apart")).alias("split"))
    # a token may equal the id of a component: both are then one cell, which compares more and loses nothing
    cell = F.when(F.col("split"), F.col("token")).otherwise(F.col("main"))
    return look_up(regions, cost, "main", "uid").select(cell.alias("cell"), "uid", "root", "open").distinct()


def _tile(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links within a tile, by the intersections of all its sets at once as a product of two incidence matrices."""

    def run(group: pa.Table) -> pa.Table:
        is_row = group.column("row").to_numpy()
        down, across = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        shared = group.column("shared").combine_chunks()
        size = np.diff(shared.offsets.to_numpy())
        kinds, at = places(shared.flatten().to_numpy())
        owner = np.repeat(np.arange(len(size)), size)
        both = np.zeros((len(down), len(across)), dtype=np.float32)
        for start in range(0, len(kinds), TILE_TOKENS):
            here = (at >= start) & (at < start + TILE_TOKENS)
            part = np.zeros((len(size), TILE_TOKENS), dtype=np.float32)
            part[owner[here], at[here] - start] = 1.0
            both += part[down] @ part[across].T
        both = both.astype(np.int64)
        root, n = group.column("root").to_numpy(), group.column("n").to_numpy().astype(np.int64)
        total = n[down][:, None] + n[across][None, :] - both
        linked = (100 * both >= percent * total) & (root[down][:, None] != root[across][None, :])
        r, c = np.nonzero(linked)
        u, v = forest(root[down][r], root[across][c])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


_ROWS = ["cell", "uid", "root", "open", "n", "shared"]


def _with_sets(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets of cells, with their tokens and the number of strips of their cell."""
    sizes = held.groupBy("cell").agg(
        F.ceil(F.sum(F.col("open").cast("int")) / NARROW).cast("int").alias("down"), F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("across"))
    return look_up(held, sizes, "cell", "uid").join(sets.select("uid", "n", "shared"), "uid")


def _strip(many: str):
    return F.pmod(F.xxhash64("uid"), F.col(many)).cast("int")


def _beside(held: DataFrame, sets: DataFrame, percent: int, shift: int) -> DataFrame:
    """Links (between roots) of the open sets of each strip of a cell with all of the strip ``shift`` places on."""
    rows = _with_sets(held, sets)
    left = F.struct(_strip("across").alias("i"), F.lit(True).alias("row"))
    right = F.struct(F.pmod(_strip("across") - shift, F.col("across")).cast("int").alias("i"), F.lit(False).alias("row"))
    rows = rows.select(*_ROWS, F.explode(F.when(F.col("open"), F.array(left, right)).otherwise(F.array(right))).alias("at"))  # not a union: the joins run once
    return rows.select(*_ROWS, "at.*").groupBy("cell", "i").applyInArrow(_tile(percent), "u long, v long")


def _all_tiles(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the open sets of a cell and any other of its sets, of another component.

    A set is sent once for each strip of the other side, so what moves grows with the sets and strips, not with the pairs.
    """
    rows = _with_sets(held, sets)
    every = lambda many, to: F.transform(F.sequence(F.lit(0), F.col(many) - 1), to)
    at = lambda i, j, row: F.struct(i.alias("i"), j.alias("j"), F.lit(row).alias("row"))
    left = every("across", lambda j: at(_strip("down"), j, True))
    right = every("down", lambda i: at(i, _strip("across"), False))
    rows = rows.select(*_ROWS, F.explode(F.when(F.col("open"), F.concat(left, right)).otherwise(right)).alias("at"))
    return rows.select(*_ROWS, "at.*").groupBy("cell", "i", "j").applyInArrow(_tile(percent), "u long, v long")


def compare(held: DataFrame, sets: DataFrame, percent: int, edges: DataFrame) -> DataFrame:
    """``edges`` and the links (u, v) that connect whatever sets of a cell link: ``held`` has (cell, uid, root, open), ``edges`` what gave the roots.

    A cell of one strip is one tile. Of larger cells each strip is compared with itself and then with the next one; what links connect by then is
    one component, is not measured again and gives no further link. The sets still outside of their cell's main component are at last compared with all
    of it. A tile returns one link for each component that it joins to another.
    """
    held = stored(held)
    for shift in (0, 1):
        edges = edges.unionByName(stored(_beside(held, sets, percent, shift)))
        many = held.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > WIDE).select("cell")
        held = look_up(held, many, "cell", "uid")
        held = stored(opened(stored(rooted(held.select("cell", "uid"), edges)), "cell").drop("main"))
        if held.isEmpty():
            return edges
    return edges.unionByName(stored(_all_tiles(held, sets, percent)))
