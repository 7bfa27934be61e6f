"""Label preparation: polygons, areas and images to training frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import bbox, centroid, ring_to_pixels, scale_ring
from ..operators.labels import boundary_gaps, clip_extent, clip_raster, density_fixed, rasterize
from ..operators.painting import BOUNDS, PART, TILE, deal, tiles_between
from ..operators.spatial_join import area_image_hits, assign_first_area, join_boxes, number_frames
from ..session import cut_lineage
from ..sources.io import frame_counts, read_frames

TASK_PIXELS = 1 << 19  # of frames, merged by one task: their layers meet in a hash table that should not spill


@dataclass
class LabelFrames:
    """The tables of a label run: one row per frame, per frame polygon, and per frame pixel."""

    frames: DataFrame
    polygons: DataFrame
    pixels: DataFrame
    counts: DataFrame


def build_label_frames(
    pixels: DataFrame, images: DataFrame, areas: DataFrame, crowns: DataFrame, bands: list[str], res: float,
    cell: float, size: int = 15, sigma: float = 4.0, scale: float = 1.5, block: int = 64,
) -> LabelFrames:
    """Every (image, area) overlap as a frame with bands, annotation, boundary and density; images without pixels are left out.

    ``images`` is (image_id, xmin, ymin, xmax, ymax), ``areas`` (id, ring), ``crowns`` (id, ring).
    """
    boxed = areas.select("id", *[e.alias(n) for n, e in bbox("ring").items()])
    # frames without pixels are not worth numbering and labelling
    present = images.join(pixels.select("image_id").distinct(), "image_id", "left_semi")
    hits = area_image_hits(boxed, present, cell)
    # annotation, gaps, density and counts all start at these two: written once
    frames = cut_lineage(number_frames(clip_extent(hits, res)))
    owned = cut_lineage(crowns.select(F.col("id").alias("polygon_id"), "ring").join(assign_first_area(crowns, areas, cell), "polygon_id"))
    x0, y0, r = F.col("x0"), F.col("y0"), F.col("res")

    # a frame's layers are made and merged where the tiles of its image are dealt to: crowns travel there, pixels of layers never do
    side = block * -(-TILE // block)
    of = ["image_id", *PART, "frame_id"]
    tiles = _tiles(frames, side)
    pixel_count = frames.agg(F.sum(F.col("rows").cast("long") * F.col("cols"))).first()[0] or 0
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixel_count // TASK_PIXELS))

    def near(shapes: DataFrame, box: dict[str, Column]) -> DataFrame:
        """Crowns, or what is left of them, with the tiles of their area's frames that ``box`` may reach, dealt by tile."""
        boxed = shapes.withColumns(box).where(F.col("xmin").isNotNull())
        pairs = join_boxes(boxed, tiles, side * float(res), on=["area_id"])
        columns = {c: "r_" + c for c in (*of, *BOUNDS, "rows", "cols", "x0", "y0", "res")} | {c: "l_" + c for c in shapes.columns if c != "area_id"}
        return deal(pairs.select(*[F.col(old).alias(c) for c, old in columns.items()]), ["image_id", *PART], parts)

    def wider(box: dict[str, Column], by: float) -> dict[str, Column]:
        return {c: e - F.lit(by) if c.endswith("min") else e + F.lit(by) for c, e in box.items()}

    def on_grid(pixels: Column) -> Column:
        return F.transform(pixels, lambda p: F.struct(p["col"].cast("double").alias("x"), p["row"].cast("double").alias("y")))

    outlined = near(owned, wider(bbox("ring"), 2.0 * res))
    annotation = rasterize(
        outlined.select(*of, *BOUNDS, F.col("polygon_id").alias("id"), on_grid(ring_to_pixels("ring", x0, y0, r)).alias("ring")), of, "id",
    ).withColumnRenamed("value", "annotation")
    own, scaled = bbox("ring"), bbox(scale_ring("ring", scale))
    either = {c: (F.least if c.endswith("min") else F.greatest)(own[c], scaled[c]) for c in own}
    ring = F.transform("ring", lambda p: F.struct(((p["x"] - x0) / r).alias("x"), ((y0 - p["y"]) / r).alias("y")))
    gaps = boundary_gaps(
        near(owned.select("area_id", "ring"), wider(either, 1.0 * res)).select(*of, *BOUNDS, ring.alias("ring")), of, scale,
    ).withColumn("boundary", F.lit(1))
    centres = owned.select("area_id", centroid("ring").alias("c"))
    at = {"xmin": F.col("c.x"), "ymin": F.col("c.y"), "xmax": F.col("c.x"), "ymax": F.col("c.y")}
    points = near(centres, wider(at, (size + 2.0) * res)).select(
        *of, *BOUNDS, "rows", "cols",
        F.floor((y0 - F.col("c.y")) / r).cast("int").alias("row"), F.floor((F.col("c.x") - x0) / r).cast("int").alias("col"))
    density = density_fixed(points, of, size, sigma)
    clipped = clip_raster(
        pixels.select("image_id", "row", "col", *bands),
        frames.select("frame_id", "image_id", "row0", "col0", "rows", "cols", "x0", "y0", "res"), block, side, parts)
    image = clipped.select(*of, "row", "col", *bands)
    table = read_frames({"image": image, "annotation": annotation, "boundary": gaps, "density": density}, [*of, "row", "col"])
    placed = owned.join(frames.select("frame_id", "area_id", "x0", "y0", "res"), "area_id")
    polygons = placed.select("frame_id", F.col("polygon_id").alias("id"), ring_to_pixels("ring", x0, y0, r).alias("pixels"))
    return LabelFrames(frames, polygons, table.drop("image_id", *PART), frame_counts(frames, polygons))


def _tiles(frames: DataFrame, side: int) -> DataFrame:
    """Frames once for each tile of their image that they touch, with the rows and columns that lie there and the box of these."""
    tiles = frames
    for c, t in zip(("row", "col"), PART):
        first = F.col(c + "0")
        tiles = tiles.withColumn(t, F.explode(tiles_between(first, first + F.col(c + "s") - 1, side))).withColumns({
            c + "_from": F.greatest(F.col(t) * side - first, F.lit(0)),
            c + "_to": F.least((F.col(t) + 1) * side - first, F.col(c + "s"))})
    x0, y0, r = F.col("x0"), F.col("y0"), F.col("res")
    box = {"xmin": x0 + F.col("col_from") * r, "ymin": y0 - F.col("row_to") * r, "xmax": x0 + F.col("col_to") * r, "ymax": y0 - F.col("row_from") * r}
    return tiles.select("image_id", *PART, "frame_id", "area_id", *BOUNDS, "rows", "cols", "x0", "y0", "res", *[e.alias(n) for n, e in box.items()])
