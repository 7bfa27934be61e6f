"""Spatial joins through grid cells.

Both sides are exploded to the cells their boxes touch, so the join is an equi join on the
cell and never a nested loop. A pair that meets in several cells is kept in one of them only,
the lowest cell the two boxes share, which needs no distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import bbox, boxes_meet, edges, first_points, indexed_intersect, rings_bbox, scale_ring, sides_intersect, slab_index
from ..functions.numbering import ordered_number

BOX = ("xmin", "ymin", "xmax", "ymax")


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def _to_cells(df: DataFrame, size: float) -> DataFrame:
    across = F.sequence(_cell(F.col("xmin"), size), _cell(F.col("xmax"), size))
    down = F.sequence(_cell(F.col("ymin"), size), _cell(F.col("ymax"), size))
    return df.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in ("_cx", "_cy")], "_cx", "_cy")


def _box(prefix: str) -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in BOX}


def join_boxes(left: DataFrame, right: DataFrame, cell: float, on: list[str] | None = None, salt: int = 1) -> DataFrame:
    """All (left, right) pairs whose boxes meet; columns come back as ``l_*`` and ``r_*``.

    ``on`` names equality columns both sides have. ``salt`` splits every cell of the left
    side in that many parts and repeats the right side for each, for cells that one executor
    could not take; AQE splits skewed sort-merge joins on its own as well.
    """
    a, b = _side(_to_cells(left, cell), "l_"), _side(_to_cells(right, cell), "r_")
    keys = ["_cx", "_cy"]
    if salt > 1:
        # a hash of the row itself: the same row gets the same salt when a lost task is run again
        spread = F.pmod(F.xxhash64(*[F.col("l_" + c) for c in left.columns]), F.lit(salt))
        a = a.withColumn("_salt", spread.cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    for k in on or []:
        a, b = a.withColumn("_on_" + k, F.col("l_" + k)), b.withColumn("_on_" + k, F.col("r_" + k))
        keys.append("_on_" + k)
    first_shared = (F.col("_cx") == F.greatest(_cell(F.col("l_xmin"), cell), _cell(F.col("r_xmin"), cell))) & (
        F.col("_cy") == F.greatest(_cell(F.col("l_ymin"), cell), _cell(F.col("r_ymin"), cell))
    )
    return a.join(b, keys).where(first_shared & boxes_meet(_box("l_"), _box("r_"))).drop(*keys)


def with_bbox(df: DataFrame, ring: str = "ring") -> DataFrame:
    return df.withColumns(bbox(ring))


def check_crs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reference systems that only one of the layers has: empty when they agree."""
    seen = a.select("srid", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select("srid", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    return (
        seen.groupBy("srid").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
        .where(F.col("in_a") != F.col("in_b"))
    )


def assign_first_area(polygons: DataFrame, areas: DataFrame, cell: float, salt: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(polygon_id, area_id): every polygon goes to the first area, in id order, it intersects.

    Rows without a ring take no part, see ``null_geometries``.
    """
    keep = keep or []

    def prepared(df: DataFrame) -> DataFrame:
        # edges are taken once per geometry and not once per pair
        boxed = with_bbox(df.where(F.col("ring").isNotNull()).select("id", "ring", *keep))
        return boxed.withColumn("sides", edges("ring")).drop("ring")

    pairs = join_boxes(prepared(polygons), prepared(areas), cell, on=keep, salt=salt)
    hits = pairs.where(sides_intersect("l_sides", "r_sides"))
    return hits.groupBy(F.col("l_id").alias("polygon_id"), *[F.col("l_" + k).alias(k) for k in keep]).agg(
        F.min("r_id").alias("area_id")
    )


SLABS = 8  # of a cell's height: edges of two geometries are compared within one of them


def intersecting_pairs(left: DataFrame, right: DataFrame, cell: float, on: list[str] | None = None, salt: int = 1) -> DataFrame:
    """(l_id, r_id, l_<on>...) of the geometries that intersect; both sides are (id, rings, on...), ``rings`` all rings of all parts, holes included.

    A point is inside where an odd number of rings goes round it. Geometries without rings or with an empty list take no part.
    """
    on, height = on or [], cell / SLABS

    def prepared(df: DataFrame) -> DataFrame:
        boxed = df.where(F.size("rings") > 0).select("id", "rings", *on).withColumns(rings_bbox("rings")).where(F.col("xmin").isNotNull())
        return boxed.withColumns({"edges": slab_index("rings", height), "points": first_points("rings")}).drop("rings")

    pairs = join_boxes(prepared(left), prepared(right), cell, on=on, salt=salt)
    hits = pairs.where(indexed_intersect(F.col("l_edges"), F.col("l_points"), F.col("r_edges"), F.col("r_points"), height))
    return hits.select("l_id", "r_id", *["l_" + k for k in on])


def assign_first_area_of_parts(polygons: DataFrame, areas: DataFrame, cell: float, salt: int = 1) -> DataFrame:
    """``assign_first_area`` for geometries of several parts, with holes: (id, rings) on both sides."""
    hits = intersecting_pairs(polygons, areas, cell, salt=salt)
    return hits.groupBy(F.col("l_id").alias("polygon_id")).agg(F.min("r_id").alias("area_id"))


def null_geometries(polygons: DataFrame) -> DataFrame:
    return polygons.where(F.col("ring").isNull()).select("id")


def overlapping_pairs(polygons: DataFrame, cell: float, area: str = "area_id", k: float = 1.0, salt: int = 1) -> DataFrame:
    """Ordered pairs i ≠ j inside one area whose (scaled) boxes meet.

    Only these pairs can have a common part; pairs that are apart are never formed.
    """
    ring = F.col("ring") if k == 1.0 else scale_ring("ring", k)
    p = with_bbox(polygons.select("id", area, ring.alias("ring"))).drop("ring")
    pairs = join_boxes(p, p, cell, on=[area], salt=salt).where(F.col("l_id") != F.col("r_id"))
    return pairs.select(F.col("l_" + area).alias(area), F.col("l_id").alias("i"), F.col("r_id").alias("j"))


def area_image_hits(areas: DataFrame, images: DataFrame, cell: float, salt: int = 1) -> DataFrame:
    """(area_id, image_id) with both boxes: box of the area meets box of the image."""
    pairs = join_boxes(areas.select("id", *BOX), images.select("image_id", *BOX), cell, salt=salt)
    return pairs.select(
        F.col("l_id").alias("area_id"), F.col("r_image_id").alias("image_id"),
        *[F.col("l_" + c).alias("area_" + c) for c in BOX], *[F.col("r_" + c).alias("image_" + c) for c in BOX],
    )


def unmatched_areas(areas: DataFrame, hits: DataFrame) -> DataFrame:
    return areas.select(F.col("id").alias("area_id")).join(hits.select("area_id"), "area_id", "left_anti")


def multi_image_areas(hits: DataFrame) -> DataFrame:
    """Areas that span several images. Distinct pairs first, so no set is kept per area."""
    pairs = hits.select("area_id", "image_id").distinct()
    return pairs.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_images")).where(F.col("n_images") > 1)


def check_pair_counts(main: DataFrame, aux: DataFrame, key: str = "image_id") -> DataFrame:
    """Keys whose main and auxiliary rasters yield different numbers of frames."""
    a = main.groupBy(key).agg(F.count(F.lit(1)).alias("n_main"))
    b = aux.groupBy(key).agg(F.count(F.lit(1)).alias("n_aux"))
    zero = F.lit(0).cast("long")
    return (
        a.join(b, key, "full_outer")
        .select(key, F.coalesce("n_main", zero).alias("n_main"), F.coalesce("n_aux", zero).alias("n_aux"))
        .where(F.col("n_main") != F.col("n_aux"))
    )


def number_frames(hits: DataFrame, start: int = 0) -> DataFrame:
    """Running frame number over (image, area), carried across images."""
    numbered = ordered_number(hits, ["image_id", "area_id"], "frame_id")
    return numbered.withColumn("frame_id", F.col("frame_id") + F.lit(start))
