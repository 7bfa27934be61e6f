"""From polygons and points to label rasters: masks, gaps, density maps, smoothed labels, frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.geometry import bbox, scale_ring
from ..schemas import floor_div
from ..session import cut_lineage, spread
from .painting import BOUNDS, PART, cut_to_parts, deal, filled_rings, gap_spots, paint, stamped_points
from .resample import convolve_separable, gaussian_weights

# --- clipping ----------------------------------------------------------------------------------


def clip_extent(hits: DataFrame, res: float) -> DataFrame:
    """Row and column range of each (area, image) overlap, all touched pixels, in image coordinates.

    ``hits`` comes from ``area_image_hits``; image origin is its upper left corner.
    """
    x0, y0, r = F.col("image_xmin"), F.col("image_ymax"), F.lit(float(res))
    west, east = F.greatest("area_xmin", "image_xmin"), F.least("area_xmax", "image_xmax")
    south, north = F.greatest("area_ymin", "image_ymin"), F.least("area_ymax", "image_ymax")
    c0 = F.floor((west - x0) / r).cast("int")
    r0 = F.floor((y0 - north) / r).cast("int")
    c1 = F.greatest(F.ceil((east - x0) / r).cast("int"), c0 + 1)
    r1 = F.greatest(F.ceil((y0 - south) / r).cast("int"), r0 + 1)
    return hits.select(
        "area_id", "image_id", r0.alias("row0"), c0.alias("col0"), (r1 - r0).alias("rows"), (c1 - c0).alias("cols"),
        (x0 + c0 * r).alias("x0"), (y0 - r0 * r).alias("y0"), r.alias("res"),
    )


_NARROW = "_short_"  # before the names of columns that hold a column's numbers in 16 bits


def _fits(values: pa.Array) -> bool:
    """Numbers that 16 bits hold without loss; bits are compared, so that a negative zero stays one."""
    whole = values.drop_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        return whole.astype(np.int16).astype(whole.dtype).tobytes() == whole.tobytes()


def _pack(names: list[str], numbers: list[str], block: int) -> Callable:
    """Pixels as they come to one row for each block of an image, each column a list: lists of their own are small once compressed.

    ``numbers`` have a second list, of 16 bits, for what fits there; the other of the two is null.
    """
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.and_(pc.and_(table["image_id"].is_valid(), table["row"].is_valid()), table["col"].is_valid()))
            if not len(table):
                continue
            image = table["image_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            at = [table[c].to_numpy().astype(np.int64) // block for c in ("row", "col")]
            low, span = [a.min() for a in at], [int(a.max() - a.min()) + 1 for a in at]
            key = (image * span[0] + at[0] - low[0]) * span[1] + at[1] - low[1]
            if key.max() < 1 << 16:
                key = key.astype(np.uint16)  # sorted in linear time
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
            table = table.take(pa.array(order))
            ends = pa.array(np.append(first, len(order)), pa.int32())
            columns = {"image_id": table["image_id"].combine_chunks().take(pa.array(first))} | {
                b: pa.array(a[order][first], pa.int32()) for b, a in zip(("_br", "_bc"), at)}
            for n in names:
                values = table[n].combine_chunks()
                short = n in numbers and _fits(values)
                columns[n] = pa.nulls(len(first), pa.list_(values.type)) if short else pa.ListArray.from_arrays(ends, values)
                if n in numbers:
                    columns[_NARROW + n] = pa.ListArray.from_arrays(ends, values.cast(pa.int16())) if short else pa.nulls(len(first), pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def clip_raster(pixels: DataFrame, extents: DataFrame, block: int = 64, tile: int | None = None, parts: int | None = None) -> DataFrame:
    """Pixels of each extent with rows and columns rebased to it; equi join on the tiles an extent touches.

    Pixels are packed by block where they are, and unpacked for each extent after the join. Rows are dealt by tiles of
    ``tile`` pixels a side, whole blocks, to ``parts`` tasks; with ``tile`` the tile's columns ``_tr`` and ``_tc`` are kept.
    """
    kept, tile = tile is not None, tile or block
    names = [c for c in pixels.columns if c != "image_id"]
    types = {n: T.ArrayType(pixels.schema[n].dataType) for n in names}
    numbers = [n for n in names if isinstance(types[n].elementType, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType))]
    lists = [T.StructField(m, t) for n in names for m, t in ((n, types[n]), (_NARROW + n, T.ArrayType(T.ShortType()))) if m in names or n in numbers]
    schema = T.StructType([pixels.schema["image_id"], T.StructField("_br", T.IntegerType()), T.StructField("_bc", T.IntegerType()), *lists])
    packed = pixels.mapInArrow(_pack(names, numbers, block), schema).withColumns({
        t: floor_div(F.col(b) * block, tile) for t, b in zip(PART, ("_br", "_bc"))})
    touched = extents
    for c, t in zip(("row", "col"), PART):
        touched = touched.withColumn(t, F.explode(F.sequence(
            floor_div(F.col(c + "0"), tile), floor_div(F.col(c + "0") + F.col(c + "s") - 1, tile))))
    # merged and never broadcast: Spark takes pixels that were exploded from few rows for a small table
    keys = ["image_id", *PART]
    joined = deal(packed, keys, parts).hint("merge").join(deal(touched, keys, parts), keys)
    for c, b in (("row", "_br"), ("col", "_bc")):
        joined = joined.where((F.col(b) * block < F.col(c + "0") + F.col(c + "s")) & (F.col(c + "0") < (F.col(b) + 1) * block))
    rest = [c for c in extents.columns if c not in ("image_id", "row0", "col0", "x0", "y0", "res")]
    unpacked = joined.withColumns({n: F.coalesce(n, F.col(_NARROW + n).cast(types[n])) for n in numbers})
    single = unpacked.select("image_id", *PART, "row0", "col0", *rest, F.inline(F.arrays_zip(*names)))
    r, c = F.col("row") - F.col("row0"), F.col("col") - F.col("col0")
    inside = single.where((r >= 0) & (r < F.col("rows")) & (c >= 0) & (c < F.col("cols"))).withColumns({"row": r, "col": c})
    return inside.select("image_id", *(PART if kept else []), *names, *rest)


# --- polygons to pixels ---------------------------------------------------------------------------


def _pixel_box(box: dict[str, Column], grid: int = 1) -> dict[str, Column]:
    """First and last row and column of pixels that a box in pixel coordinates (x = column, y = row) touches."""
    of = {"row_low": ("ymin", F.floor), "row_high": ("ymax", F.ceil), "col_low": ("xmin", F.floor), "col_high": ("xmax", F.ceil)}
    return {k: way(box[c] / F.lit(grid)).cast("int") for k, (c, way) in of.items()}


def rasterize(
    polygons: DataFrame, keys: list[str], seq: str, fill: int = 1, outline: int = 0, shape: bool = True
) -> DataFrame:
    """Polygons in pixel coordinates (x = column, y = row) to ``value`` per pixel.

    The outline gets its own value, and the last polygon in ``seq`` order wins. Filled row by
    row from edge crossings, so a pixel never looks at the whole ring. With ``shape`` the
    table carries ``rows``/``cols`` and pixels outside are dropped. Columns: keys, row, col, value.
    Polygons that carry the bounds of a part (see ``painting``) are cut to it and not shuffled; ``keys`` then name the part.
    """
    box = _pixel_box(bbox("ring"))
    shapes, of = cut_to_parts(polygons, keys, box, shape)
    painted = paint(shapes, of, {"seq": F.col(seq).cast("long"), "ring": F.col("ring")}, filled_rings(fill, outline), "int")
    return painted.select(*keys, "row", "col", "value")


GAP_GRID = 3  # sample points along a pixel's side that say whether a gap touches it


def boundary_gaps(polygons: DataFrame, keys: list[str], k: float = 1.5, shape: bool = True, grid: int = GAP_GRID) -> DataFrame:
    """Pixels touched by a spot that lies in at least two scaled polygons and in no original one, per frame.

    This is the union of the pairwise intersections of scaled polygons minus all originals, without forming pairs: the polygons that
    cover a spot are counted along its row. Spots are the ``grid`` × ``grid`` sample points of a pixel, so strips between close crowns
    that are thinner than a pixel, down to 1/``grid`` of it, are found. Polygons with the bounds of a part: as in ``rasterize``.
    """
    def fine(ring: Column) -> Column:
        return F.transform(ring, lambda p: F.struct((p["x"] * grid).alias("x"), (p["y"] * grid).alias("y")))

    own, scaled = bbox("ring"), bbox(scale_ring("ring", k))
    box = {c: (F.least if c.endswith("min") else F.greatest)(own[c], scaled[c]) for c in own}
    shapes, of = cut_to_parts(polygons, keys, _pixel_box(box), shape)
    gaps = paint(shapes, of, {"scaled": fine(scale_ring("ring", k)), "own": fine(F.col("ring"))}, gap_spots(grid), "int", grid, 1)
    return gaps.select(*keys, "row", "col")


# --- points to pixels --------------------------------------------------------------------------------


def point_mask(points: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels that hold at least one point; ``points`` carries row, col, rows, cols."""
    inside = F.col("row").between(0, F.col("rows") - 1) & F.col("col").between(0, F.col("cols") - 1)
    return points.where(inside).select(*keys, "row", "col").distinct().withColumn("value", F.lit(1))


def kernel_2d(size: int, sigma: float) -> list[list[float]]:
    line = gaussian_weights(size, sigma)
    return [[a * b for b in line] for a in line]


DENSITY_BLOCK = 64  # pixels; side of the blocks whose points are spread by one task


def density_fixed(points: DataFrame, keys: list[str], size: int = 15, sigma: float = 4.0) -> DataFrame:
    """Adds one unit-mass Gaussian per point; mass beyond the edge is lost.

    The kernel sits one pixel below and right of the point. Points at or beyond the far edge
    are skipped. Points of one pixel are counted first, so a crowded pixel is spread once, and along
    rows and columns in turn. Points with the bounds of a part: as in ``rasterize``.
    """
    half = (size - 1) // 2
    reach = size - half  # farthest a point above or left of the frame still reaches into it
    kept = points.where(
        (F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols"))
        & (F.col("row") + reach >= 0) & (F.col("col") + reach >= 0))
    at = [c for c in ("row", "col", "rows", "cols", *BOUNDS) if c in points.columns]
    counted = kept.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("n"))
    box = {c + end: F.col(c) + F.lit(by) for c in ("row", "col") for end, by in (("_low", 1 - half), ("_high", reach))}
    shapes, of = cut_to_parts(counted, keys, box, True)
    density = paint(shapes, of, {c: F.col(c) for c in ("row", "col", "n")}, stamped_points(gaussian_weights(size, sigma)), "double", pad=size - 1)
    return density.select(*keys, "row", "col", F.col("value").alias("density"))


def knn_distances(points: DataFrame, keys: list[str], k: int = 3, cell: int = 16) -> DataFrame:
    """Distances of each distinct pixel position to its k nearest other points, per frame.

    Points of one pixel are one row with a count ``n`` (its twins are neighbours at distance 0),
    so a cell holds at most cell² rows however crowded it is. A point is settled once k
    neighbours lie nearer than the 3×3 cells around it reach; the rest go on with cells twice
    as wide until the cells span the frame. Columns: keys, row, col, n, total, rows, cols, dist.
    """
    placed = cut_lineage(points.groupBy(*keys, "row", "col", "rows", "cols").agg(F.count(F.lit(1)).alias("n")))
    placed = placed.join(placed.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    span = placed.agg(F.max("rows"), F.max("cols")).first()
    if span[0] is None:
        return placed.withColumn("dist", F.array().cast("array<double>"))
    widest = max(span[0], span[1])
    known = placed.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("n").alias("_n"))
    around = F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    open_points, settled = placed, []
    while True:
        last = cell >= widest
        asked = open_points.withColumn("_a", F.explode(around)).withColumns({
            "_cr": floor_div(F.col("row"), cell) + F.col("_a.r"), "_cc": floor_div(F.col("col"), cell) + F.col("_a.c"),
        }).drop("_a")
        held = known.withColumns({"_cr": floor_div(F.col("_row"), cell), "_cc": floor_div(F.col("_col"), cell)})
        pairs = asked.join(held, [*keys, "_cr", "_cc"])
        own = (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col"))
        dr, dc = (F.col("row") - F.col("_row")).cast("double"), (F.col("col") - F.col("_col")).cast("double")
        pairs = pairs.withColumns({
            "_d": F.sqrt(dr * dr + dc * dc), "_m": F.least(F.col("_n") - own.cast("long"), F.lit(k)),
        })
        names = [*keys, "row", "col", "rows", "cols", "n", "total"]
        rank = Window.partitionBy(*names).orderBy("_d", "_row", "_col")
        nearest = pairs.withColumn("_i", F.row_number().over(rank)).where(F.col("_i") <= k + 1)
        found = nearest.groupBy(*names).agg(F.slice(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("_d", "_i", "_m"))),
            lambda s: F.array_repeat(s["_d"], s["_m"].cast("int")),
        )), 1, k).alias("dist"))
        if last:
            settled.append(found)
            break
        complete = (F.size("dist") == k) & (F.element_at("dist", -1) <= F.lit(float(cell)))
        found = cut_lineage(found.withColumn("_ok", F.coalesce(complete, F.lit(False))))
        settled.append(found.where("_ok").drop("_ok"))
        open_points = found.where(~F.col("_ok")).drop("_ok", "dist")
        if open_points.isEmpty():
            break
        cell *= 2
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _blur_profile(at: Column, extent: Column, sigma: Column, truncate: float = 4.0) -> Column:
    """1-D response of a blurred pulse, not yet normalised: ARRAY<STRUCT<p, w>>, nearest edge mode, cut at 4 sigma."""
    radius = F.floor(sigma * F.lit(truncate) + 0.5).cast("int")

    def g(d: Column) -> Column:
        return F.when(sigma > 0, F.exp(F.try_divide(-(d * d), 2 * sigma * sigma))).otherwise(F.lit(1.0))

    def response(p: Column) -> Column:
        # beyond the far edge the last pixel is repeated, so a pulse on it also answers for those copies
        tail = F.aggregate(F.sequence(extent - 1 - p, F.greatest(radius, extent - 1 - p)), F.lit(0.0),
                           lambda acc, d: acc + g(d.cast("double")))
        return F.when(at == extent - 1, tail).otherwise(g((p - at).cast("double")))

    positions = F.sequence(F.greatest(F.lit(0), at - radius), F.least(extent - 1, at + radius))
    return F.transform(positions, lambda p: F.struct(p.alias("p"), response(p).alias("w")))


def density_knn(points: DataFrame, keys: list[str]) -> DataFrame:
    """Unit-mass Gaussian per point whose sigma is 0.3 × the mean distance to its 3 (2, 1) nearest points.

    A lone point takes a quarter of the mean frame side. Points on row or column 0 or outside are skipped.
    """
    near = knn_distances(points, keys, 3)
    inside = (F.col("row") > 0) & (F.col("row") < F.col("rows")) & (F.col("col") > 0) & (F.col("col") < F.col("cols"))
    mean = F.aggregate("dist", F.lit(0.0), lambda acc, d: acc + d) / F.greatest(F.size("dist"), F.lit(1))
    sigma = F.when(F.col("total") == 1, (F.col("rows") + F.col("cols")) / F.lit(8.0)).otherwise(mean * F.lit(0.3))
    shaped = near.where(inside).withColumn("sigma", sigma)
    block = {"_br": floor_div(F.col("row"), DENSITY_BLOCK), "_bc": floor_div(F.col("col"), DENSITY_BLOCK)}
    shaped = spread(shaped.withColumns(block), *keys, "_br", "_bc")
    profiles = shaped.select(
        *keys, "n", _blur_profile(F.col("row"), F.col("rows"), F.col("sigma")).alias("_down"),
        _blur_profile(F.col("col"), F.col("cols"), F.col("sigma")).alias("_across"))

    def mass(profile: str) -> Column:
        return F.aggregate(profile, F.lit(0.0), lambda acc, s: acc + s["w"])

    lines = profiles.select(
        *keys, "_across", (F.col("n") / (mass("_down") * mass("_across"))).alias("_unit"), F.explode("_down").alias("_r"))
    full = lines.select(*keys, "_unit", "_r", F.explode("_across").alias("_c"))
    return full.groupBy(*keys, F.col("_r.p").alias("row"), F.col("_c.p").alias("col")).agg(
        F.sum(F.col("_unit") * F.col("_r.w") * F.col("_c.w")).alias("density"))


# --- label masks -------------------------------------------------------------------------------------------


def smooth_labels(
    df: DataFrame, value: str, size: int, sigma: float, dims: int = 2, keys: list[str] | None = None
) -> DataFrame:
    """Spatially varying label smoothing: a Gaussian whose peak is replaced by the sum of its neighbours.

    That kernel is a Gaussian plus a pulse, so it takes two 1-D passes and the pixel itself,
    not size² products. ``dims=3`` is the 3-D kernel over equal planes: only the peak differs.
    """
    keys = keys or ["image_id"]
    line = gaussian_weights(size, sigma)
    peak = line[(size - 1) // 2] ** dims
    neighbours = 1 - peak
    total = 1 + neighbours - peak  # kernel sum, before the common factor that cancels
    both = df.select(*keys, "row", "col", "rows", "cols", value, F.col(value).alias("_own"))
    out = convolve_separable(both, line, [value], keys, carry=["_own"])
    return out.select(*keys, "row", "col", (
        (F.col(value) + F.lit(neighbours - peak) * F.col("_own")) / F.lit(total)).alias(value))


def smooth_labels_2d(df: DataFrame, value: str, size: int = 15, sigma: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    return smooth_labels(df, value, size, sigma, 2, keys)


def smooth_labels_3d(df: DataFrame, value: str, size: int = 3, sigma: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    return smooth_labels(df, value, size, sigma, 3, keys)


def boundary_weight(value: Column | str, weight: float = 5.0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value >= 0.5, F.lit(float(weight))).otherwise(F.lit(1.0))


def binarize(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return (value >= 0.5).cast("int")

