"""Queries over polygons, areas, extents and label rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as g
from ..operators import gaps as gp, labels as lb, spatial_join as sj
from ..operators.resample import gaussian_weights
from ..plans.evaluation import load_truth as load_truth_layers
from ..plans.label_frames import build_label_frames
from ..sources import io
from . import fixtures as fx
from .fixtures import AREA_CELL, SIDE, r6 as R, with_ctes
from .registry import query, r6

# --- joins and reports -----------------------------------------------------------------------------------


@query(with_ctes(["area"], "SELECT id AS area_key, row_number() OVER (ORDER BY id) - 1 AS id FROM area"))
def number_areas(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.areas(spark, sf).select(F.col("id").alias("area_key"))
    return io.number_areas(a).select("area_key", "id")


@query(with_ctes(["assigned"], "SELECT polygon_id, area_id FROM assigned"))
def assign_first_area(spark: SparkSession, sf: str) -> DataFrame:
    return sj.assign_first_area(fx.crowns(spark, sf), fx.areas(spark, sf), AREA_CELL)


@query(with_ctes(["assigned"], "SELECT polygon_id, area_id FROM assigned"))
def assign_first_area_salted(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of the crowns split in four, as for crowded cells."""
    return sj.assign_first_area(fx.crowns(spark, sf), fx.areas(spark, sf), AREA_CELL, salt=4)


#: Crowns of two parts, 10 units apart, against areas of two parts, a frame around a hole and what lies in the middle of the hole.
_PARTS = """
    SELECT polygon_id, min(area_id) AS area_id FROM (
      SELECT c.id AS polygon_id, a.id AS area_id FROM (SELECT id, unnest([0, 10]) + xmin AS x0, unnest([0, 10]) + xmax AS x1, ymin AS y0, ymax AS y1 FROM crown) c
      JOIN area a ON (x0 <= a.xmax AND a.xmin <= x1 AND y0 <= a.ymax AND a.ymin <= y1
          AND NOT (x0 > a.xmin + 6 AND x1 < a.xmax - 6 AND y0 > a.ymin + 6 AND y1 < a.ymax - 6))
        OR (x0 <= a.xmax - 18 AND a.xmin + 18 <= x1 AND y0 <= a.ymax - 18 AND a.ymin + 18 <= y1)) GROUP BY polygon_id"""


@query(with_ctes(["crown", "area"], _PARTS))
def assign_first_area_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.transform("ring", lambda p: g.point(p["x"] + 10, p["y"]))
    crowns = fx.crowns(spark, sf).select("id", F.array("ring", moved).alias("rings"))
    boxes = fx.area_boxes(spark, sf)
    inner = lambda by: g.rectangle_ring(F.col("xmin") + by, F.col("ymin") + by, F.col("xmax") - by, F.col("ymax") - by)
    areas = boxes.select("id", F.array(inner(0), inner(6), inner(18)).alias("rings"))
    return sj.assign_first_area_of_parts(crowns, areas, AREA_CELL)


@query(with_ctes(["crown"], f"""
    SELECT id, xmin, ymin, xmax, ymax, {r6('(xmin + xmax) / 2 - 0.75::DOUBLE * (xmax - xmin)')} AS sx0,
      {r6('(ymin + ymax) / 2 - 0.75::DOUBLE * (ymax - ymin)')} AS sy0, {r6('(xmax - xmin) * (ymax - ymin)')} AS area FROM crown"""))
def bbox_and_scale(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crowns(spark, sf)
    box = g.bbox(g.scale_ring("ring", 1.5))
    return c.withColumns(g.bbox("ring")).select(
        "id", "xmin", "ymin", "xmax", "ymax", R(box["xmin"]).alias("sx0"), R(box["ymin"]).alias("sy0"),
        R(g.area("ring")).alias("area"))


@query(with_ctes(["hits"], "SELECT * FROM hits"))
def join_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL)


@query(with_ctes(["area", "hits"], "SELECT id AS area_id FROM area WHERE id % 3 = 0 OR id NOT IN (SELECT area_id FROM hits)"))
def unmatched_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Every third area lies away from all images."""
    away = F.when(F.pmod("id", F.lit(3)) == 0, F.lit(1e6)).otherwise(F.lit(0.0))
    a = fx.area_boxes(spark, sf).withColumns({"xmin": F.col("xmin") + away, "xmax": F.col("xmax") + away})
    return sj.unmatched_areas(a, sj.area_image_hits(a, fx.extents(spark, sf), AREA_CELL))


@query(with_ctes(["hits"], "SELECT area_id, count(DISTINCT image_id) AS n_images FROM hits GROUP BY area_id HAVING count(DISTINCT image_id) > 1"))
def multi_image_areas(spark: SparkSession, sf: str) -> DataFrame:
    return sj.multi_image_areas(sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL))


@query(with_ctes(["hits"], """
    SELECT image_id, area_id, row_number() OVER (ORDER BY image_id, area_id) - 1 AS frame_id FROM hits"""))
def number_frames(spark: SparkSession, sf: str) -> DataFrame:
    hits = sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL).select("image_id", "area_id")
    return sj.number_frames(hits)


@query(with_ctes(["hits"], """
    SELECT image_id, coalesce(n_main, 0) AS n_main, coalesce(n_aux, 0) AS n_aux
    FROM (SELECT image_id, count(*) AS n_main FROM hits GROUP BY 1) m
    FULL JOIN (SELECT image_id, count(*) AS n_aux FROM hits WHERE image_xmin <= area_xmin GROUP BY 1) a USING (image_id)
    WHERE coalesce(n_main, 0) <> coalesce(n_aux, 0)"""))
def check_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL)
    return sj.check_pair_counts(hits, hits.where(F.col("image_xmin") <= F.col("area_xmin")))


@query(with_ctes(["assigned", "crown"], """
    SELECT a.area_id, a.polygon_id AS i, b.polygon_id AS j
    FROM (SELECT * FROM assigned JOIN crown ON id = polygon_id) a JOIN (SELECT * FROM assigned JOIN crown ON id = polygon_id) b
      ON a.area_id = b.area_id AND a.id <> b.id
      AND round(abs((a.xmin + a.xmax) / 2 - (b.xmin + b.xmax) / 2), 6) <= round(0.75::DOUBLE * (a.xmax - a.xmin + b.xmax - b.xmin), 6)
      AND round(abs((a.ymin + a.ymax) / 2 - (b.ymin + b.ymax) / 2), 6) <= round(0.75::DOUBLE * (a.ymax - a.ymin + b.ymax - b.ymin), 6)"""))
def overlapping_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered pairs of crowns of one area whose scaled boxes meet."""
    own = fx.assigned_crowns(spark, sf)
    # quarter units keep the scaled corners exact, so touching boxes count on both sides
    ring = F.transform("ring", lambda p: g.point(F.round(p["x"], 1), F.round(p["y"], 1)))
    tens = F.transform(ring, lambda p: g.point(F.rint(p["x"] * 10), F.rint(p["y"] * 10)))
    return sj.overlapping_pairs(
        own.select(F.col("polygon_id").alias("id"), F.col("frame_id").alias("area_id"), tens.alias("ring")), 160.0, k=1.5)


@query("""
    SELECT c_nationkey % 3 + 4000 AS srid, 1 AS in_a, 0 AS in_b FROM customer WHERE c_nationkey % 3 + 4000 NOT IN (SELECT s_nationkey % 2 + 4000 FROM supplier)
    GROUP BY ALL
    UNION ALL SELECT s_nationkey % 2 + 4000, 0, 1 FROM supplier WHERE s_nationkey % 2 + 4000 NOT IN (SELECT c_nationkey % 3 + 4000 FROM customer) GROUP BY ALL""")
def check_crs(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.table(spark, sf, "customer").select((F.pmod("c_nationkey", F.lit(3)) + 4000).alias("srid"))
    b = fx.table(spark, sf, "supplier").select((F.pmod("s_nationkey", F.lit(2)) + 4000).alias("srid"))
    return sj.check_crs(a, b)


# --- geometry expressions ----------------------------------------------------------------------------------

_TYPE = "CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'Polygon' WHEN segment = 'HOUSEHOLD' THEN 'MultiPolygon' ELSE 'Point' END"


def _typed(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("segment").isin("BUILDING", "MACHINERY"), "Polygon").when(
        F.col("segment") == "HOUSEHOLD", "MultiPolygon").otherwise("Point")
    return df.withColumn("geom_type", kind)


@query(with_ctes(["crown"], f"SELECT id, {_TYPE} AS geom_type FROM crown WHERE {_TYPE} <> 'Point'"))
def filter_geom_type(spark: SparkSession, sf: str) -> DataFrame:
    return g.filter_geom_type(_typed(fx.crowns(spark, sf))).select("id", "geom_type")


@query(with_ctes(["crown"], """
    SELECT id, 0 AS part, xmin FROM crown UNION ALL SELECT id, 1, xmin + 10 FROM crown"""))
def explode_parts(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.transform("ring", lambda p: g.point(p["x"] + 10, p["y"]))
    parts = g.explode_parts(fx.crowns(spark, sf).select("id", F.array("ring", moved).alias("parts")))
    return parts.select("id", "part", g.bbox("ring")["xmin"].alias("xmin"))


@query(with_ctes(["crown"], f"""
    SELECT id, {r6('(xmin + xmax) / 2')} AS cx, {r6('(ymin + ymax) / 2')} AS cy, xmin AS first_x, 5 AS n_vertices FROM crown"""))
def centroid_and_exterior(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.crowns(spark, sf).withColumn("rings", F.array("ring", g.scale_ring("ring", 0.5)))
    ext = g.exterior("rings")
    m = g.centroid(ext)
    return c.select("id", R(m["x"]).alias("cx"), R(m["y"]).alias("cy"), ext[0]["x"].alias("first_x"), F.size(ext).alias("n_vertices"))


@query(with_ctes(["own"], """
    SELECT polygon_id, frame_id, CAST(floor(y0 - ymin) AS INTEGER) AS row, CAST(floor(xmin - x0) AS INTEGER) AS col FROM own"""))
def world_to_pixel(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.assigned_crowns(spark, sf).withColumns(g.bbox("ring"))
    at = g.world_to_pixel("xmin", "ymin", F.col("x0"), F.col("y0"), F.lit(1.0))
    return own.select("polygon_id", "frame_id", at["row"].alias("row"), at["col"].alias("col"))


# --- clipping and rasterising ------------------------------------------------------------------------------------

_EXTENT = ("ce", """
    SELECT area_id, image_id, c0 AS col0, r0 AS row0, greatest(r1, r0 + 1) - r0 AS rows, greatest(c1, c0 + 1) - c0 AS cols FROM (
      SELECT area_id, image_id, CAST(floor(greatest(area_xmin, image_xmin) - image_xmin) AS INTEGER) AS c0,
        CAST(ceil(least(area_xmax, image_xmax) - image_xmin) AS INTEGER) AS c1,
        CAST(floor(image_ymax - least(area_ymax, image_ymax)) AS INTEGER) AS r0,
        CAST(ceil(image_ymax - greatest(area_ymin, image_ymin)) AS INTEGER) AS r1 FROM hits)""")


@query(with_ctes(["hits"], "SELECT area_id, image_id, row0, col0, rows, cols FROM ce", extra=[_EXTENT]))
def clip_extents(spark: SparkSession, sf: str) -> DataFrame:
    hits = sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL)
    return lb.clip_extent(hits, 1.0).select("area_id", "image_id", "row0", "col0", "rows", "cols")


@query(with_ctes(["hits", "px"], """
    SELECT ce.area_id, ce.image_id, count(*) AS n_px, sum(red) AS red, sum(red * (row - row0)) AS red_row
    FROM ce JOIN px ON px.image_id = ce.image_id AND row >= row0 AND row < row0 + rows AND col >= col0 AND col < col0 + cols
    GROUP BY 1, 2""", extra=[_EXTENT]))
def clip_raster(spark: SparkSession, sf: str) -> DataFrame:
    hits = sj.area_image_hits(fx.area_boxes(spark, sf), fx.extents(spark, sf), AREA_CELL)
    out = lb.clip_raster(fx.pixels(spark, sf), lb.clip_extent(hits, 1.0), 16)
    return out.groupBy("area_id", "image_id").agg(
        F.count(F.lit(1)).alias("n_px"), F.sum("red").alias("red"), F.sum(F.col("red") * F.col("row")).alias("red_row"))


def _grid_rings(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.assigned_crowns(spark, sf)
    px = g.ring_to_pixels("ring", F.col("x0"), F.col("y0"), F.lit(1.0))
    ring = F.transform(px, lambda p: g.point(p["col"], p["row"]))
    return own.select("frame_id", F.col("polygon_id").alias("id"), "rows", "cols", ring.alias("ring"))


_BOXES = ("bx", """
    SELECT frame_id, polygon_id, rows, cols, CAST(floor(y0 - ymax) AS INTEGER) AS r0, CAST(floor(y0 - ymin) AS INTEGER) AS r1,
      CAST(floor(xmin - x0) AS INTEGER) AS c0, CAST(floor(xmax - x0) AS INTEGER) AS c1 FROM own""")


@query(with_ctes(["own"], """
    SELECT frame_id, row, col, arg_max(value, polygon_id) AS value FROM (
      SELECT frame_id, polygon_id, r.range AS row, c.range AS col,
        CASE WHEN r.range IN (r0, r1) OR c.range IN (c0, c1) THEN 0 ELSE 1 END AS value
      FROM bx JOIN range(60) r ON r.range BETWEEN r0 AND r1 AND r.range < rows JOIN range(60) c ON c.range BETWEEN c0 AND c1 AND c.range < cols)
    GROUP BY frame_id, row, col""", extra=[_BOXES]))
def rasterize_crowns(spark: SparkSession, sf: str) -> DataFrame:
    """Filled crowns with outline 0; the last crown wins."""
    return lb.rasterize(_grid_rings(spark, sf), ["frame_id"], "id", 1, 0)


@query(with_ctes(["own"], """
    SELECT DISTINCT frame_id, CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col FROM (
      SELECT frame_id, r.range AS row, c.range AS col,
        count(*) FILTER (r.range + 0.5 >= 3 * sr0 AND r.range + 0.5 < 3 * sr1 AND c.range + 0.5 >= 3 * sc0 AND c.range + 0.5 < 3 * sc1) AS scaled,
        count(*) FILTER (r.range + 0.5 >= 3 * pr0 AND r.range + 0.5 < 3 * pr1 AND c.range + 0.5 >= 3 * pc0 AND c.range + 0.5 < 3 * pc1) AS own
      FROM (SELECT frame_id, rows, cols, y0 - ymax AS pr0, y0 - ymin AS pr1, xmin - x0 AS pc0, xmax - x0 AS pc1,
              y0 - ((ymin + ymax) / 2 + 0.75::DOUBLE * (ymax - ymin)) AS sr0, y0 - ((ymin + ymax) / 2 - 0.75::DOUBLE * (ymax - ymin)) AS sr1,
              (xmin + xmax) / 2 - 0.75::DOUBLE * (xmax - xmin) - x0 AS sc0, (xmin + xmax) / 2 + 0.75::DOUBLE * (xmax - xmin) - x0 AS sc1 FROM own) b
      JOIN range(180) r ON r.range < 3 * rows AND r.range BETWEEN floor(3 * sr0) AND ceil(3 * sr1)
      JOIN range(180) c ON c.range < 3 * cols AND c.range BETWEEN floor(3 * sc0) AND ceil(3 * sc1)
      GROUP BY 1, 2, 3) WHERE scaled >= 2 AND own = 0"""))
def boundary_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels between close crowns, thin strips included."""
    own = fx.assigned_crowns(spark, sf)
    ring = F.transform("ring", lambda p: g.point(p["x"] - F.col("x0"), F.col("y0") - p["y"]))
    return lb.boundary_gaps(own.select("frame_id", "rows", "cols", ring.alias("ring")), ["frame_id"])


@query(with_ctes(["own"], f"""
    SELECT frame_id, {r6('sum(w * h)')} AS area FROM (
      SELECT f.frame_id, x.w, y.h, count(*) FILTER (x.x > sx0 AND x.x < sx1 AND y.y > sy0 AND y.y < sy1) AS scaled,
        count(*) FILTER (x.x > px0 AND x.x < px1 AND y.y > py0 AND y.y < py1) AS own
      FROM bo f JOIN (SELECT frame_id, (v + lead(v) OVER q) / 2 AS x, lead(v) OVER q - v AS w FROM (
          SELECT DISTINCT frame_id, unnest([sx0, sx1, px0, px1]) AS v FROM bo) WINDOW q AS (PARTITION BY frame_id ORDER BY v)) x USING (frame_id)
        JOIN (SELECT frame_id, (v + lead(v) OVER q) / 2 AS y, lead(v) OVER q - v AS h FROM (
          SELECT DISTINCT frame_id, unnest([sy0, sy1, py0, py1]) AS v FROM bo) WINDOW q AS (PARTITION BY frame_id ORDER BY v)) y
          ON y.frame_id = f.frame_id AND y.y > sy0 AND y.y < sy1 AND x.x > sx0 AND x.x < sx1
      GROUP BY f.frame_id, x.x, x.w, y.y, y.h) WHERE scaled >= 2 AND own = 0 GROUP BY frame_id""", extra=[("bo", """
    SELECT frame_id, px0, px1, py0, py1, (px0 + px1) / 2 - 0.75::DOUBLE * (px1 - px0) AS sx0, (px0 + px1) / 2 + 0.75::DOUBLE * (px1 - px0) AS sx1,
      (py0 + py1) / 2 - 0.75::DOUBLE * (py1 - py0) AS sy0, (py0 + py1) / 2 + 0.75::DOUBLE * (py1 - py0) AS sy1
    FROM (SELECT frame_id, xmin - x0 AS px0, xmax - x0 AS px1, y0 - ymax AS py0, y0 - ymin AS py1 FROM own)""")]))
def gap_polygon_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area between close crowns by the exact overlay."""
    own = fx.assigned_crowns(spark, sf)
    ring = F.transform("ring", lambda p: g.point(p["x"] - F.col("x0"), F.col("y0") - p["y"]))
    parts = gp.gap_parts(gp.gap_polygons(own.select("frame_id", ring.alias("ring")), ["frame_id"]), ["frame_id"])
    return parts.groupBy("frame_id").agg(R(F.sum("area")).alias("area"))


@query(with_ctes(["pts"], """
    SELECT DISTINCT frame_id, row, col, 1 AS value FROM pts WHERE row BETWEEN 0 AND rows - 1 AND col BETWEEN 0 AND cols - 1"""))
def point_mask(spark: SparkSession, sf: str) -> DataFrame:
    return lb.point_mask(fx.crown_points(spark, sf), ["frame_id"])


_KERNEL = ("kern", """
    SELECT CAST(i.range AS INTEGER) - 6 AS dr, CAST(j.range AS INTEGER) - 6 AS dc,
      exp(-((i.range - 7) * (i.range - 7) + (j.range - 7) * (j.range - 7)) / 32.0::DOUBLE)
        / sum(exp(-((i.range - 7) * (i.range - 7) + (j.range - 7) * (j.range - 7)) / 32.0::DOUBLE)) OVER () AS w
    FROM range(15) i, range(15) j""")


@query(with_ctes(["pts"], f"""
    SELECT frame_id, row + dr AS row, col + dc AS col, {r6('sum(w)')} AS density FROM pts, kern
    WHERE row < rows AND col < cols AND row + dr BETWEEN 0 AND rows - 1 AND col + dc BETWEEN 0 AND cols - 1 GROUP BY 1, 2, 3""",
                 extra=[_KERNEL]))
def density_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = lb.density_fixed(fx.crown_points(spark, sf), ["frame_id"])
    return out.withColumn("density", R("density"))


_NEAR = ("near", """
    SELECT frame_id, polygon_id, row, col, rows, cols, total, list(d ORDER BY d)[1:3] AS dist FROM (
      SELECT a.*, count(*) OVER (PARTITION BY a.frame_id, a.polygon_id) AS total,
        CASE WHEN b.polygon_id = a.polygon_id THEN NULL ELSE sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) END AS d
      FROM pts a JOIN pts b ON a.frame_id = b.frame_id) GROUP BY ALL""")


@query(with_ctes(["pts"], f"""
    SELECT DISTINCT frame_id, row, col, total, {r6('coalesce(list_sum(list_filter(dist, lambda x: x IS NOT NULL)), 0)')} AS dist FROM near""",
                 extra=[_NEAR]))
def knn_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the distances to the three nearest other points of the frame."""
    out = lb.knn_distances(fx.crown_points(spark, sf), ["frame_id"], 3)
    total = F.aggregate("dist", F.lit(0.0), lambda a, d: a + d)
    return out.select("frame_id", "row", "col", "total", R(total).alias("dist"))


_PROFILE = """
    SELECT frame_id, polygon_id, p, w / sum(w) OVER (PARTITION BY frame_id, polygon_id) AS w FROM (
      SELECT frame_id, polygon_id, p, sum(exp(-(p + k - {at}) * (p + k - {at}) / (2 * sigma * sigma))) AS w FROM (
        SELECT s.*, CAST(p.range AS INTEGER) AS p, CAST(k.range AS INTEGER) - radius AS k
        FROM sig s JOIN range(60) p ON p.range < {extent} JOIN range(500) k ON k.range <= 2 * radius)
      WHERE greatest(0, least({extent} - 1, p + k)) = {at} AND abs(p - {at}) <= radius GROUP BY 1, 2, 3)"""

# the weight of a blur tap depends on its own offset k, the pulse being reached through the repeated edge
_PROFILE = _PROFILE.replace("(p + k - {at}) * (p + k - {at})", "CAST(k AS DOUBLE) * k")


@query(with_ctes(["pts"], f"""
    SELECT r.frame_id, r.p AS row, c.p AS col, {r6('sum(r.w * c.w)')} AS density FROM pr r JOIN pc c USING (frame_id, polygon_id) GROUP BY 1, 2, 3""",
                 extra=[_NEAR, ("sig", """
    SELECT *, CAST(floor(4 * sigma + 0.5) AS INTEGER) AS radius FROM (
      SELECT *, CASE WHEN total = 1 THEN (rows + cols) / 8.0::DOUBLE
        ELSE greatest(0.3::DOUBLE * list_sum(list_filter(dist, lambda x: x IS NOT NULL)) / len(list_filter(dist, lambda x: x IS NOT NULL)), 1e-9) END AS sigma FROM near)
    WHERE row > 0 AND row < rows AND col > 0 AND col < cols"""),
                        ("pr", _PROFILE.format(at="row", extent="rows")), ("pc", _PROFILE.format(at="col", extent="cols"))]))
def density_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Density with a kernel as wide as the crowns are far apart."""
    return lb.density_knn(fx.crown_points(spark, sf), ["frame_id"]).withColumn("density", R("density"))


# --- label masks ------------------------------------------------------------------------------------------------------


def _smooth_sql(size: int, sigma: float, dims: int) -> str:
    half = (size - 1) // 2
    line = gaussian_weights(size, sigma)
    peak = line[half] ** dims
    kernel = f"""SELECT CAST(i.range AS INTEGER) - {half} AS dr, CAST(j.range AS INTEGER) - {half} AS dc,
      exp(-((i.range - {half}) * (i.range - {half}) + (j.range - {half}) * (j.range - {half})) / {2 * sigma * sigma!r}::DOUBLE)
        / sum(exp(-((i.range - {half}) * (i.range - {half}) + (j.range - {half}) * (j.range - {half})) / {2 * sigma * sigma!r}::DOUBLE)) OVER ()
        + CASE WHEN i.range = {half} AND j.range = {half} THEN {1 - 2 * peak!r}::DOUBLE ELSE 0 END AS w
      FROM range({size}) i, range({size}) j"""
    return with_ctes(["px"], f"""
    SELECT o.image_id, o.row, o.col, {r6('sum(k.w * i.value) / (SELECT sum(w) FROM kern)')} AS value
    FROM m o CROSS JOIN kern k JOIN m i ON i.image_id = o.image_id AND i.row = greatest(0, least({SIDE - 1}, o.row + k.dr))
      AND i.col = greatest(0, least({SIDE - 1}, o.col + k.dc)) GROUP BY 1, 2, 3""", extra=[
        ("m", "SELECT image_id, row, col, CASE WHEN red >= 128 THEN 1.0 ELSE 0.0 END AS value FROM px"), ("kern", kernel)])


def _mask_value(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sized_pixels(spark, sf).select(
        "image_id", "row", "col", "rows", "cols", (F.col("red") >= 128).cast("double").alias("value"))


@query(_smooth_sql(5, 2.0, 2))
def smooth_labels_2d(spark: SparkSession, sf: str) -> DataFrame:
    return lb.smooth_labels_2d(_mask_value(spark, sf), "value", 5, 2.0).withColumn("value", R("value"))


@query(_smooth_sql(3, 1.0, 3))
def smooth_labels_3d(spark: SparkSession, sf: str) -> DataFrame:
    return lb.smooth_labels_3d(_mask_value(spark, sf), "value").withColumn("value", R("value"))


@query(with_ctes(["px"], """
    SELECT image_id, row, col, CASE WHEN blue / 255 >= 0.5 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      CASE WHEN red / 255 >= 0.5 THEN 1 ELSE 0 END AS ann FROM px"""))
def boundary_weight(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf)
    return px.select(
        "image_id", "row", "col", lb.boundary_weight(F.col("blue") / 255).alias("weight"), lb.binarize(F.col("red") / 255).alias("ann"))


# --- frames -------------------------------------------------------------------------------------------------------------


@query(with_ctes(["frame", "own"], """
    SELECT frame_id, count(polygon_id) AS n FROM frame LEFT JOIN own USING (frame_id) GROUP BY frame_id"""))
def frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    return io.frame_counts(fx.area_frames(spark, sf), fx.assigned_crowns(spark, sf).select("frame_id", "polygon_id"))


@query(with_ctes(["own"], """
    SELECT frame_id, '{"Trees":[' || string_agg('[[' || r1 || ',' || c0 || '],[' || r1 || ',' || c1 || '],[' || r0 || ',' || c1 || '],['
      || r0 || ',' || c0 || '],[' || r1 || ',' || c0 || ']]', ',' ORDER BY polygon_id) || ']}' AS value FROM bx GROUP BY frame_id""",
                 extra=[_BOXES]))
def annotation_json(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.assigned_crowns(spark, sf)
    px = g.ring_to_pixels("ring", F.col("x0"), F.col("y0"), F.lit(1.0))
    return io.annotation_json(own.select("frame_id", F.col("polygon_id").alias("id"), px.alias("pixels")))


@query(with_ctes(["px"], """
    SELECT image_id, row, col, red, CASE WHEN red >= 144 THEN 1 ELSE 0 END AS annotation,
      CASE WHEN blue >= 150 THEN 1 ELSE 0 END AS boundary, green / 4096 AS density FROM px"""))
def read_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Image, sparse annotation, sparse boundary and density as one table."""
    px = fx.pixels(spark, sf)
    keys = ["image_id", "row", "col"]
    return io.read_frames({
        "image": px.select(*keys, "red"),
        "annotation": px.where(F.col("red") >= 144).select(*keys, F.lit(1).alias("annotation")),
        "boundary": px.where(F.col("blue") >= 150).select(*keys, F.lit(1).alias("boundary")),
        "density": px.select(*keys, (F.col("green") / 4096).alias("density")),
    }, keys)


@query(with_ctes(["px"], """
    SELECT image_id, row, col, CASE WHEN red >= 144 THEN 1 ELSE 0 END AS annotation, CASE WHEN blue >= 150 THEN 1 ELSE 0 END AS boundary,
      CASE WHEN green >= 100 THEN green / 4096 ELSE 0 END AS density FROM px"""))
def load_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The label layers of each frame, from files that only their names put together; boundary and density are sparse."""
    px = fx.pixels(spark, sf)

    def layer(name: str, value, there=F.lit(True)) -> DataFrame:
        path = F.concat(F.lit("/labels/d"), F.pmod("image_id", F.lit(3)).cast("string"), F.lit(f"/{name}_"), F.col("image_id").cast("string"), F.lit(".tif"))
        return px.where(there).select(path.alias("path"), "row", "col", value.cast("double").alias("value"))

    files = layer("annotation", F.col("red") >= 144).unionByName(
        layer("boundary", F.lit(1), F.col("blue") >= 150)).unionByName(layer("density", F.col("green") / 4096, F.col("green") >= 100))
    truth = load_truth_layers(files.select("path").distinct(), files)
    key = F.regexp_extract("frame_key", "_([0-9]+)[.]", 1).cast("long")
    return truth.select(key.alias("image_id"), "row", "col", F.col("annotation").cast("int").alias("annotation"), F.col("boundary").cast("int").alias("boundary"), "density")


@query(with_ctes(["px"], "SELECT image_id, row, col, red, green, infrared FROM px"))
def stack_bands(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf)
    return io.stack_bands([px.select("image_id", "row", "col", b) for b in ("red", "green", "infrared")])


@query(with_ctes(["hits", "assigned", "crown", "epx"], f"""
    SELECT f.frame_id, count(*) AS n_px, sum(p.red) AS red, CAST(sum(coalesce(a.value, 0)) AS BIGINT) AS annotation, count(b.row) AS boundary,
      {r6('sum(coalesce(d.density, 0))')} AS density
    FROM fr f JOIN epx p ON p.image_id = f.image_id AND p.row >= row0 AND p.row < row0 + rows AND p.col >= col0 AND p.col < col0 + cols
    LEFT JOIN ann a ON a.frame_id = f.frame_id AND a.row = p.row - row0 AND a.col = p.col - col0
    LEFT JOIN dens d ON d.frame_id = f.frame_id AND d.row = p.row - row0 AND d.col = p.col - col0
    LEFT JOIN gap b ON b.frame_id = f.frame_id AND b.row = p.row - row0 AND b.col = p.col - col0
    GROUP BY f.frame_id""", extra=[_EXTENT, ("fr", """
    SELECT row_number() OVER (ORDER BY c.image_id, c.area_id) - 1 AS frame_id, c.*, h.image_xmin + col0 AS x0, h.image_ymax - row0 AS y0
    FROM ce c JOIN hits h USING (area_id, image_id)"""), ("gap", """
    SELECT DISTINCT frame_id, row // 3 AS row, col // 3 AS col FROM (
      SELECT frame_id, r.range AS row, c.range AS col,
        count(*) FILTER (r.range + 0.5 >= 3 * sr0 AND r.range + 0.5 < 3 * sr1 AND c.range + 0.5 >= 3 * sc0 AND c.range + 0.5 < 3 * sc1) AS scaled,
        count(*) FILTER (r.range + 0.5 >= 3 * pr0 AND r.range + 0.5 < 3 * pr1 AND c.range + 0.5 >= 3 * pc0 AND c.range + 0.5 < 3 * pc1) AS own
      FROM (SELECT frame_id, rows, cols, y0 - ymax AS pr0, y0 - ymin AS pr1, xmin - x0 AS pc0, xmax - x0 AS pc1,
              y0 - ((ymin + ymax) / 2 + 0.75::DOUBLE * (ymax - ymin)) AS sr0, y0 - ((ymin + ymax) / 2 - 0.75::DOUBLE * (ymax - ymin)) AS sr1,
              (xmin + xmax) / 2 - 0.75::DOUBLE * (xmax - xmin) - x0 AS sc0, (xmin + xmax) / 2 + 0.75::DOUBLE * (xmax - xmin) - x0 AS sc1
            FROM fr JOIN assigned USING (area_id) JOIN crown ON crown.id = polygon_id) b
      JOIN range(180) r ON r.range < 3 * rows AND r.range BETWEEN floor(3 * sr0) AND ceil(3 * sr1)
      JOIN range(180) c ON c.range < 3 * cols AND c.range BETWEEN floor(3 * sc0) AND ceil(3 * sc1)
      GROUP BY 1, 2, 3) WHERE scaled >= 2 AND own = 0"""), ("bx", """
    SELECT frame_id, polygon_id, rows, cols, floor(y0 - ymax) AS r0, floor(y0 - ymin) AS r1, floor(xmin - x0) AS c0, floor(xmax - x0) AS c1,
      CAST(floor((y0 - (ymin + ymax) / 2)) AS INTEGER) AS row, CAST(floor((xmin + xmax) / 2 - x0) AS INTEGER) AS col
    FROM fr JOIN assigned USING (area_id) JOIN crown ON crown.id = polygon_id"""), ("ann", """
    SELECT frame_id, row, col, arg_max(value, polygon_id) AS value FROM (
      SELECT frame_id, polygon_id, r.range AS row, c.range AS col,
        CASE WHEN r.range IN (r0, r1) OR c.range IN (c0, c1) THEN 0 ELSE 1 END AS value
      FROM bx JOIN range(90) r ON r.range BETWEEN r0 AND r1 AND r.range < rows JOIN range(90) c ON c.range BETWEEN c0 AND c1 AND c.range < cols)
    GROUP BY frame_id, row, col"""), _KERNEL, ("dens", """
    SELECT frame_id, row + dr AS row, col + dc AS col, sum(w) AS density FROM bx, kern
    WHERE row < rows AND col < cols AND row + dr BETWEEN 0 AND rows - 1 AND col + dc BETWEEN 0 AND cols - 1 GROUP BY 1, 2, 3""")]))
def label_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The whole label run over every overlap of an area and an image: crops, annotation, gaps, density; summed per frame."""
    built = build_label_frames(
        fx.extent_pixels(spark, sf), fx.extents(spark, sf), fx.areas(spark, sf), fx.crowns(spark, sf), ["red"], 1.0, AREA_CELL, block=16)
    return built.pixels.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_px"), F.sum("red").alias("red"), F.sum("annotation").alias("annotation"),
        F.sum("boundary").alias("boundary"), R(F.sum("density")).alias("density"))
