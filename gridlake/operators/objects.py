"""Connected objects in masks, their areas and counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import clip_negative
from ..schemas import floor_div
from ..session import cut_lineage

PIXEL_AREA = 0.04  # fixed value: square metres of a 20 cm pixel


def count_by_density(dens: DataFrame, keys: list[str] | None = None, density: str = "density") -> DataFrame:
    """Objects = sum of the density without its negatives."""
    return dens.groupBy(*(keys or ["image_id"])).agg(F.sum(clip_negative(density)).alias("n_objects"))


SPAN = 8  # blocks along a side of what one task labels at a time


def _label_blocks(size: int, diagonal: bool):
    """In-block labelling of neighbouring blocks at once, by repeated minimum over neighbours; at most size² pixels a block, SPAN² blocks."""
    shifts = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])

    def run(group: pa.Table) -> pa.Table:
        row, col = group.column("row").to_numpy(), group.column("col").to_numpy()
        width = size * SPAN
        _, first = np.unique(row % width * width + col % width, return_index=True)  # a pixel may come twice
        group, row, col = group.take(pa.array(first)), row[first], col[first]
        _, block = np.unique(row // size % SPAN * SPAN + col // size % SPAN, return_inverse=True)
        r, c = row % size, col % size
        far = size * size
        padded = np.full((block.max() + 1, size + 2, size + 2), far, dtype=np.int32)
        padded[block, r + 1, c + 1] = r * size + c
        inner = padded[:, 1:-1, 1:-1]
        off = inner == far
        while True:
            before = inner.copy()
            best = before.copy()
            for dr, dc in shifts:
                np.minimum(best, padded[:, 1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc], out=best)
            best[off] = far
            # jump: a pixel takes the label its label pixel has by now
            flat = np.concatenate([best.reshape(len(best), -1), np.full((len(best), 1), far, dtype=np.int32)], axis=1)
            inner[:] = np.take_along_axis(flat, best.reshape(len(best), -1), 1).reshape(best.shape)
            if np.array_equal(inner, before):
                break
        return group.append_column("local", pa.array(padded[block, r + 1, c + 1], pa.int64()))

    return run


def _packed(row: Column, col: Column) -> Column:
    """A position as one BIGINT in row-major order."""
    return F.shiftleft(row.cast("long"), 32).bitwiseOR(col.cast("long"))


def _unpacked(position: Column) -> Column:
    return F.struct(
        F.shiftright(position, 32).cast("int").alias("row"), position.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"))


def _local_labels(mask: DataFrame, keys: list[str], size: int, diagonal: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with ``node``: the position of the first pixel of their in-block component, row and column in one BIGINT."""
    on = mask.select(*keys, "row", "col", *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in on.schema.fields)
    spans = [floor_div(F.col(c), size * SPAN).alias(f"_{c}s") for c in ("row", "col")]
    local = on.groupBy(*keys, *spans).applyInArrow(_label_blocks(size, diagonal), f"{fields}, local bigint")
    top, left = floor_div(F.col("row"), size) * size, floor_div(F.col("col"), size) * size
    node = _packed(top + floor_div(F.col("local"), size), left + F.pmod("local", F.lit(size)))
    return local.select(*keys, "row", "col", *carry, node.alias("node"))


def _border_edges(labelled: DataFrame, keys: list[str], size: int, diagonal: bool) -> DataFrame:
    """Pairs of in-block components that touch across a block border, found by equality on the pixel."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    rim = labelled.where(
        (F.pmod("row", F.lit(size)) == 0) | (F.pmod("row", F.lit(size)) == size - 1)
        | (F.pmod("col", F.lit(size)) == 0) | (F.pmod("col", F.lit(size)) == size - 1)
    )
    asks = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in steps]))
    left = rim.select(*keys, "row", "col", F.col("node").alias("u"), asks.alias("_s"))
    left = left.select(
        *keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), "u")
    right = rim.select(*keys, "row", "col", F.col("node").alias("v"))
    return left.join(right, [*keys, "row", "col"]).where(F.col("u") != F.col("v")).select(*keys, "u", "v").distinct()


def connect(edges: DataFrame, keys: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """Components of an edge table as (keys, node, root), root being the smallest node.

    Alternates the large-star and small-star steps until nothing changes, which takes few rounds
    whatever the diameter. Each step is a minimum (combined before the shuffle) joined back; the edges of a hub are one skewed
    side of that join, which adaptive execution splits. Rounds are compared by the number of edges and the sum of their hashes.
    """
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("sum")]
    current = cut_lineage(edges.select(*keys, F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
                          .where(F.col("a") != F.col("b")).distinct())
    before = current.agg(*mark).first()
    while True:
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, [*keys, "a"]).where(F.col("b") > F.col("a")).select(
            *keys, F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        down = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        joined = large.join(down, [*keys, "a"])
        small = joined.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        small = small.unionByName(down.select(*keys, "a", F.col("m").alias("b"))).distinct()
        current = cut_lineage(small)
        after = current.agg(*mark).first()
        if after == before:
            return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def label_components(
    mask: DataFrame, keys: list[str] | None = None, connectivity: int = 8, block: int = 64, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Every mask pixel with ``component``, the position (row, col) of its component's first pixel in row-major order.

    Blocks are labelled on their own; only components that touch a block border enter the
    iterative part. ``mask`` holds the object pixels; ``carry`` names columns of it that stay.
    """
    keys = keys or ["image_id"]
    diagonal = connectivity == 8
    labelled = cut_lineage(_local_labels(mask, keys, block, diagonal, carry))
    edges = _border_edges(labelled, keys, block, diagonal)
    roots = connect(edges, keys)
    return labelled.join(roots, [*keys, "node"], "left").select(
        *keys, "row", "col", *carry, _unpacked(F.coalesce("root", "node")).alias("component"))


def count_components(components: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["image_id"]
    return components.select(*keys, "component").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects"))


def label_holes(
    pixels: DataFrame, value: str, keys: list[str] | None = None, block: int = 64, connectivity: int = 4
) -> DataFrame:
    """Background components (4-connected) that do not reach the image edge; ``pixels`` has rows/cols."""
    keys = keys or ["image_id"]
    comps = label_components(pixels.where(F.col(value) == 0), keys, connectivity, block, ("rows", "cols"))
    edge = (
        (F.col("row") == 0) | (F.col("col") == 0)
        | (F.col("row") == F.col("rows") - 1) | (F.col("col") == F.col("cols") - 1)
    )
    open_ones = comps.where(edge).select(*keys, "component").distinct()
    return comps.drop("rows", "cols").join(open_ones, [*keys, "component"], "left_anti")


def count_holes(pixels: DataFrame, value: str, keys: list[str] | None = None, block: int = 64) -> DataFrame:
    keys = keys or ["image_id"]
    holes = label_holes(pixels, value, keys, block).select(*keys, "component").distinct()
    return holes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_holes"))


def object_area(components: DataFrame, keys: list[str] | None = None, component: str = "component") -> DataFrame:
    """Per component: ``px_area`` (pixels) and ``contour_area``, the polygon through the centres of its border pixels.

    That polygon covers a unit square of four neighbouring centres wholly where all four pixels
    are set, half where three are, and not at all otherwise: single pixels and lines give 0.
    It is one count per square, without a self join. The pixels are taken as they are; ``contour_measures`` counts
    what lies inside an outline, holes included.
    """
    keys = keys or ["image_id"]
    corners = F.explode(F.array(*[
        F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (0, -1), (-1, 0), (-1, -1))
    ]))
    votes = components.select(*keys, "row", "col", component, corners.alias("_s")).select(
        *keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), component)
    squares = votes.groupBy(*keys, "row", "col", component).agg(F.count(F.lit(1)).alias("n"))
    inside = F.when(F.col("n") == 4, F.lit(1.0)).when(F.col("n") == 3, F.lit(0.5)).otherwise(F.lit(0.0))
    # every pixel votes in four squares, so the votes of a component are four times its pixels
    return squares.groupBy(*keys, component).agg(
        F.floor(F.sum("n") / 4).cast("long").alias("px_area"), F.sum(inside).alias("contour_area"))


@dataclass
class ContourTree:
    """Components of a mask and of its background as a tree: holes in objects, objects in holes.

    ``objects`` and ``holes`` are pixels (keys, row, col, node), ``rims`` the pixels of a hole's object beside it (keys, row, col, node of the hole), ``up`` (keys, node,
    parent), ``within`` (keys, node, contour) every component with all that enclose it, itself first. A node packs the first pixel and the kind (1: hole).
    """

    objects: DataFrame
    holes: DataFrame
    rims: DataFrame
    up: DataFrame
    within: DataFrame


def contour_tree(pixels: DataFrame, value: str, keys: list[str] | None = None, block: int = 64) -> ContourTree:
    """The tree of a mask; ``pixels`` has rows/cols. Background that reaches the image's edge is no part of it.

    What encloses a component is what its first pixel in row-major order has above it, so nesting is one look-up for each component
    and as many rounds as outlines lie in one another, of a row a component.
    """
    keys = keys or ["image_id"]

    def of(df: DataFrame, kind: int) -> DataFrame:
        node = _packed(F.col("component.row"), F.col("component.col") * 2).bitwiseOR(F.lit(kind).cast("long"))
        first = (F.col("row") == F.col("component.row")) & (F.col("col") == F.col("component.col"))
        return df.select(*keys, "row", "col", node.alias("node"), first.alias("first"))

    objects = cut_lineage(of(label_components(pixels.where(F.col(value) == 1), keys, 8, block), 0))
    holes = cut_lineage(of(label_holes(pixels, value, keys, block), 1))

    def parents(inner: DataFrame, outer: DataFrame) -> DataFrame:
        above = inner.where("first").select(*keys, "node", (F.col("row") - 1).alias("row"), "col")
        return above.join(outer.select(*keys, "row", "col", F.col("node").alias("parent")), [*keys, "row", "col"]).select(*keys, "node", "parent")

    up = cut_lineage(parents(holes, objects).unionByName(parents(objects, holes)))
    level = up.select(*keys, "node", F.col("parent").alias("contour"))
    nodes = objects.unionByName(holes).where("first").select(*keys, "node")
    within = nodes.withColumn("contour", F.col("node"))
    step = up.select(*keys, F.col("node").alias("contour"), F.col("parent").alias("_next"))
    while not level.isEmpty():
        within = within.unionByName(level)
        level = cut_lineage(level.join(step, [*keys, "contour"]).select(*keys, "node", F.col("_next").alias("contour")))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    beside = holes.select(*keys, "row", "col", "node", sides.alias("_s")).select(
        *keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), "node").distinct()
    # what lies beside a hole is the hole itself, an object in it, or the object it is in: that is the rim
    owners = objects.select(*keys, "row", "col", F.col("node").alias("parent"))
    rims = cut_lineage(beside.join(owners, [*keys, "row", "col"]).join(up, [*keys, "node", "parent"], "left_semi").select(*keys, "row", "col", "node"))
    return ContourTree(objects.drop("first"), holes.drop("first"), rims, up, within)


def _square_area(n: Column) -> Column:
    """Part of a unit square between four pixel centres that a polygon through so many of them covers."""
    return F.when(n == 4, F.lit(1.0)).when(n == 3, F.lit(0.5)).otherwise(F.lit(0.0))


def _votes(df: DataFrame, keys: list[str], *carry: Column | str) -> DataFrame:
    """Each pixel in its four squares."""
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (0, -1), (-1, 0), (-1, -1))]))
    return df.select(*keys, "row", "col", *carry, corners.alias("_s")).select(
        *keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), *carry)


def contour_measures(tree: ContourTree, keys: list[str] | None = None) -> DataFrame:
    """(keys, contour, px_area, contour_area): of the outline of each object and hole with all that lies inside.

    The outline of a hole runs through the object's pixels around it. Each pixel is counted once, in its own component: squares of four pixels
    hold one object and two holes at most, and what such a square adds to a component beyond those in it is a number a component. The
    numbers are summed up the tree, a row a component; what the rim adds to a hole is its own alone.
    """
    keys = keys or ["image_id"]
    every = tree.objects.withColumn("hole", F.lit(False)).unionByName(tree.holes.withColumn("hole", F.lit(True)))
    node, hole = F.col("node"), F.col("hole")
    squares = _votes(every, keys, "node", "hole").groupBy(*keys, "row", "col").agg(
        F.max(F.when(~hole, node)).alias("o"), F.min(F.when(hole, node)).alias("h1"), F.max(F.when(hole, node)).alias("h2"),
        F.sum((~hole).cast("int")).alias("n_o"), F.sum(hole.cast("int")).alias("n_h"))
    kinds = squares.groupBy(*keys, "o", "h1", "h2", "n_o", "n_h").agg(F.count(F.lit(1)).alias("times"))
    kinds = kinds.join(tree.up.select(*keys, F.col("node").alias("o"), F.col("parent").alias("above")), [*keys, "o"], "left")
    two = F.col("h1") != F.col("h2")
    n1, n2 = F.when(two, F.lit(1)).otherwise(F.col("n_h")), F.when(two, F.lit(1)).otherwise(F.lit(0))
    outer1, outer2 = F.coalesce(F.col("above") == F.col("h1"), F.lit(False)), F.coalesce(two & (F.col("above") == F.col("h2")), F.lit(False))
    below = F.when(outer1, F.lit(0)).otherwise(n1) + F.when(outer2, F.lit(0)).otherwise(n2)
    own = _square_area(F.col("n_o") + below)  # of the object with its holes
    whole = F.when(F.col("o").isNull(), F.lit(0.0)).otherwise(own)
    top = _square_area(F.col("n_o") + F.col("n_h")) - own  # of the hole around the object
    single1, single2 = _square_area(n1), _square_area(n2)
    inner = F.when(outer1, F.lit(0.0)).otherwise(single1) + F.when(outer2 | ~F.coalesce(two, F.lit(False)), F.lit(0.0)).otherwise(single2)
    part = lambda at, v: F.struct(at.alias("node"), (v * F.col("times")).alias("area"))
    added = F.array(
        part(F.col("o"), whole - F.when(F.col("n_h") > 0, inner).otherwise(F.lit(0.0))),
        part(F.col("h1"), F.when(outer1, top).otherwise(single1)),
        part(F.when(two, F.col("h2")), F.when(outer2, top).otherwise(single2)))
    parts = kinds.select(*keys, F.explode(added).alias("p")).where(F.col("p.node").isNotNull()).select(*keys, "p.*")
    counted = every.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("px"))
    sums = cut_lineage(parts.groupBy(*keys, "node").agg(F.sum("area").alias("area")).join(counted, [*keys, "node"]))
    summed = tree.within.join(sums, [*keys, "node"]).groupBy(*keys, "contour").agg(F.sum("px").alias("px"), F.sum("area").alias("area"))

    rim_votes = _votes(tree.rims, keys, "node").withColumn("rim", F.lit(1)).unionByName(_votes(tree.holes, keys, "node").withColumn("rim", F.lit(0)))
    near = rim_votes.groupBy(*keys, "node", "row", "col").agg(F.sum("rim").alias("n_r"), F.count(F.lit(1)).alias("n")).where("n_r > 0")
    more = near.groupBy(*keys, F.col("node").alias("contour")).agg(F.sum(_square_area(F.col("n")) - _square_area(F.col("n") - F.col("n_r"))).alias("more"))
    rim_px = tree.rims.groupBy(*keys, F.col("node").alias("contour")).agg(F.count(F.lit(1)).alias("rim_px"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summed.join(more.join(rim_px, [*keys, "contour"]), [*keys, "contour"], "left").select(
        *keys, "contour", (F.col("px") + zero("rim_px")).cast("long").alias("px_area"), (F.col("area") + zero("more")).alias("contour_area"))


def remove_small(
    pixels: DataFrame, value: str, thres: float, keys: list[str] | None = None, measure: str = "contour_area", block: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(kept object pixels, counts before and after per key): erases what lies inside contours whose area is below ``thres``.

    Contours are those of objects and of holes, each counted and measured by its outline with all that lies inside.
    ``pixels`` has the whole mask in ``value``, and rows/cols.
    """
    keys = keys or ["image_id"]
    tree = contour_tree(pixels, value, keys, block)
    areas = cut_lineage(contour_measures(tree, keys))
    large = F.col(measure) >= F.lit(float(thres))
    small = areas.where(~large).select(*keys, "contour")
    gone = tree.within.join(small, [*keys, "contour"], "left_semi").select(*keys, "node").distinct()
    rims = tree.rims.join(small.withColumnRenamed("contour", "node"), [*keys, "node"], "left_semi").select(*keys, "row", "col").distinct()
    kept = tree.objects.join(gone, [*keys, "node"], "left_anti").select(*keys, "row", "col").join(rims, [*keys, "row", "col"], "left_anti")
    counts = areas.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"), F.sum(large.cast("int")).cast("long").alias("n_after"))
    return kept, counts


def cover_area(df: DataFrame, pred: str, truth: str, keys: list[str]) -> DataFrame:
    """Object pixels of prediction and truth and their ratio."""
    sums = df.groupBy(*keys).agg(F.sum(pred).alias("pred_px"), F.sum(truth).alias("truth_px"))
    return sums.withColumn("ratio", F.try_divide("pred_px", "truth_px"))


def per_hectare(count: str, n_px: str, px_area: float = PIXEL_AREA):
    """Objects per hectare of a raster of ``n_px`` pixels."""
    return F.try_divide(F.col(count), F.col(n_px) * F.lit(px_area)) * F.lit(10000.0)


def count_drop(counts: DataFrame) -> DataFrame:
    """Relative decrease of the total count by removing small objects."""
    total = counts.agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    return total.withColumn("decrease", F.try_divide(F.col("n_before") - F.col("n_after"), F.col("n_before")))


def frame_object_count(df: DataFrame, density: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(density).alias("object_count"))

