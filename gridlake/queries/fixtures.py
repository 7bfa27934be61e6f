"""Raster, vector and catalog inputs derived from the driver's tables, in Spark and as SQL text.

Everything grows with the tables: more vectors give more images, more customers more sheets
of crowns and areas, more line items more images of the big raster, more events more files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bands import threshold
from ..functions.geometry import rectangle_ring
from ..operators.scoring import LinearModel
from ..plans.inference import score_mosaic
from ..session import spread

SIDE = 80           # rows and columns of a fixture image
W, S = 32, 28       # default window and stride
BIG = 256           # rows and columns of a big image

RED = LinearModel("red", ("red",), (1.0,))
ENSEMBLE = [
    LinearModel("rgb", ("red", "green", "blue"), (0.8, -0.4, 0.3), 0.1),
    LinearModel("rgbNir", ("red", "green", "blue", "infrared"), (0.5, 0.2, -0.3, 0.4), -0.2),
    LinearModel("rgbNirNdvi", ("red", "green", "blue", "infrared", "ndvi"), (0.4, 0.1, -0.2, 0.3, 0.6), 0.05),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6)


# --- rasters -----------------------------------------------------------------------------------------------


def images(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("image_id"))
    return ids.distinct().select("image_id", F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Dense four-band raster: a vector is an 8×8 patch of the red band, its followers the other bands."""
    v = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 100).cast("long").alias("image_id"), F.pmod("vec_id", F.lit(100)).cast("int").alias("slot"),
        "embedding", "label")
    # a vector serves its own patch as red and the three patches before it as the other bands
    uses = F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.lit(i).alias("back")) for i, b in enumerate(["red", "green", "blue", "infrared"])
    ]))
    served = v.select("*", uses.alias("u")).select(
        "image_id", F.pmod(F.col("slot") - F.col("u.back"), F.lit(100)).alias("slot"), "u.band", "embedding",
        F.when(F.col("u.back") == 0, F.col("label")).alias("label"))
    per_slot = served.groupBy("image_id", "slot").agg(
        F.max("label").alias("label"),
        *[F.max(F.when(F.col("band") == b, F.col("embedding"))).alias(b) for b in ["red", "green", "blue", "infrared"]])
    px = per_slot.select(
        "image_id", "slot", "label", F.posexplode(F.arrays_zip("red", "green", "blue", "infrared")).alias("p", "v"))

    def level(band: str) -> Column:
        return F.floor((F.col(f"v.{band}").cast("double") + 1) * F.lit(127.5)).cast("double")

    empty = (F.col("label") == 9) & (F.col("p") < 4)
    return px.select(
        "image_id",
        (F.floor(F.col("slot") / 10) * 8 + F.floor(F.col("p") / 8)).cast("int").alias("row"),
        (F.pmod("slot", F.lit(10)) * 8 + F.pmod("p", F.lit(8))).cast("int").alias("col"),
        F.when(empty, F.lit(0.0)).otherwise(level("red")).alias("red"), level("green").alias("green"),
        level("blue").alias("blue"), F.when(empty, F.lit(0.0)).otherwise(level("infrared")).alias("infrared"),
    )


def sized_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumns({"rows": F.lit(SIDE), "cols": F.lit(SIDE)})


def big_images(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "lineitem").select(F.floor(F.col("l_suppkey") / 64).cast("long").alias("image_id")).distinct()
    return ids.select("image_id", F.lit(BIG).alias("rows"), F.lit(BIG).alias("cols"))


def big_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Full 256×256 rasters from line items: the highest item of a cell gives its bands, 0 where there is none."""
    names = ["red", "green", "blue", "infrared"]
    item = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_suppkey") / 64).cast("long").alias("image_id"),
        F.pmod("l_partkey", F.lit(BIG)).cast("int").alias("row"), F.array(F.pmod("l_orderkey", F.lit(BIG)).cast("int")).alias("cols"),
        F.col("l_quantity").alias("red"), (F.col("l_discount") * 100).alias("green"),
        (F.col("l_tax") * 100).alias("blue"), (F.col("l_extendedprice") / 1000).alias("infrared"))
    # an image travels as its rows; their zeros are laid out where the items of the row have come
    lines = big_images(spark, sf).select(
        "image_id", F.explode(F.sequence(F.lit(0), F.lit(BIG - 1))).alias("row"), F.lit(None).cast("array<int>").alias("cols"),
        *[F.lit(0.0).alias(n) for n in names])
    every = F.sequence(F.lit(0), F.lit(BIG - 1))
    full = item.unionByName(lines).repartition("image_id", "row").select(
        "image_id", "row", F.explode(F.coalesce("cols", every)).alias("col"), *names)
    return full.groupBy("image_id", "row", "col").agg(*[F.max(n).alias(n) for n in names])


def truth_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and prediction per pixel; every image has an empty twin with a negative id."""
    px = pixels(spark, sf)
    scored = score_mosaic(px, [RED], W, W, S).join(px.select("image_id", "row", "col", "red", "blue"), ["image_id", "row", "col"])
    full = scored.select(
        "image_id", "row", "col", (F.col("red") >= 128).cast("int").alias("truth"),
        threshold(F.round("seg", 9)).alias("pred"), F.col("seg").alias("score"), F.col("dens"),
        F.when(F.col("blue") >= 140, F.lit(5.0)).otherwise(F.lit(1.0)).alias("weight"),
        (F.col("red") / 4096).alias("truth_dens"))
    twins = F.explode(F.array(F.lit(False), F.lit(True)))
    both = full.withColumn("twin", twins)
    keep = ~F.col("twin")
    return both.select(
        F.when(keep, F.col("image_id")).otherwise(-1 - F.col("image_id")).alias("image_id"), "row", "col",
        *[F.when(keep, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("truth", "pred")],
        *[F.when(keep, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("score", "dens", "truth_dens")], "weight")


def object_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Bright pixels as small objects: (image_id, row, col, mask, rows, cols)."""
    return sized_pixels(spark, sf).select("image_id", "row", "col", (F.col("red") >= 144).cast("int").alias("mask"), "rows", "cols")


# --- polygons ----------------------------------------------------------------------------------------------------

AREA_CELL = 64.0
EXTENT = 60         # side of an image extent


def crowns(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangular crowns, 1,500 per sheet of 250 × 250 units; sheets lie side by side."""
    c = table(spark, sf, "customer").where(F.col("c_custkey").isNotNull())
    sheet = F.floor(F.col("c_custkey") / 1500).cast("long")
    cx = sheet * 250 + F.pmod(F.col("c_custkey") * 37, F.lit(2500)) / 10.0
    cy = F.pmod(F.col("c_custkey") * 101, F.lit(2500)) / 10.0
    hw, hh = 1 + F.pmod("c_custkey", F.lit(4)), 1 + F.pmod("c_nationkey", F.lit(3))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), sheet.alias("sheet"),
        rectangle_ring(cx - hw, cy - hh, cx + hw, cy + hh).alias("ring"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """One area per (sheet, nation with customers there): even ones overlap, odd ones leave gaps."""
    pairs = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 1500).cast("long").alias("sheet"), F.col("c_nationkey").cast("long").alias("n")).distinct()
    x0 = F.col("sheet") * 250 + F.pmod("n", F.lit(5)) * 50
    y0 = F.floor(F.col("n") / 5) * 50
    side = F.when(F.pmod("n", F.lit(2)) == 0, F.lit(55)).otherwise(F.lit(45))
    return pairs.select(
        (F.col("sheet") * 25 + F.col("n")).alias("id"), "sheet",
        rectangle_ring(x0, y0, x0 + side, y0 + side).alias("ring"))


def area_boxes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.spatial_join import with_bbox

    return with_bbox(areas(spark, sf)).drop("ring")


def extents(spark: SparkSession, sf: str) -> DataFrame:
    """Image extents: boxes of side 60, 100 per sheet."""
    s = table(spark, sf, "supplier")
    x0 = F.floor(F.col("s_suppkey") / 100) * 250 + F.pmod(F.col("s_suppkey") * 53, F.lit(200))
    y0 = F.pmod(F.col("s_suppkey") * 29, F.lit(200))
    return s.select(
        F.col("s_suppkey").alias("image_id"), x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"),
        (x0 + EXTENT).cast("double").alias("xmax"), (y0 + EXTENT).cast("double").alias("ymax"))


def extent_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A red band for every extent, one pixel a unit."""
    # few bytes become many pixels: they are laid out by all tasks
    few = spread(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    grid = few.select(
        F.col("s_suppkey").alias("image_id"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(EXTENT - 1))).alias("row"),
    ).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(EXTENT - 1))))
    level = F.pmod(F.col("image_id") * 31 + F.col("s_nationkey") * 5 + F.col("row") * 7 + F.col("col") * 13, F.lit(256))
    return grid.select("image_id", "row", "col", level.cast("double").alias("red"))


def area_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Areas as frames on a 1-unit grid whose upper left corner is the area's."""
    return area_boxes(spark, sf).select(
        F.col("id").alias("frame_id"), (F.col("ymax") - F.col("ymin")).cast("int").alias("rows"),
        (F.col("xmax") - F.col("xmin")).cast("int").alias("cols"), F.col("xmin").alias("x0"), F.col("ymax").alias("y0"))


def assigned_crowns(spark: SparkSession, sf: str) -> DataFrame:
    """Crowns with the frame of their first area."""
    from ..operators.spatial_join import assign_first_area

    c = crowns(spark, sf)
    hit = assign_first_area(c, areas(spark, sf), AREA_CELL)
    return c.select(F.col("id").alias("polygon_id"), "ring", "segment").join(hit, "polygon_id").join(
        area_frames(spark, sf), F.col("area_id") == F.col("frame_id")).drop("area_id")


def crown_points(spark: SparkSession, sf: str) -> DataFrame:
    """Crown centroids as pixels of their frame."""
    from ..functions.geometry import centroid

    c = assigned_crowns(spark, sf).withColumn("c", centroid("ring"))
    return c.select(
        "frame_id", "polygon_id", "rows", "cols", F.floor(F.col("y0") - F.round("c.y", 6)).cast("int").alias("row"),
        F.floor(F.round("c.x", 6) - F.col("x0")).cast("int").alias("col"))


# --- catalog ---------------------------------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    key = F.floor(F.col("event_id") / 10).cast("long")
    folder = F.concat(F.lit("/imagery/d"), F.pmod("user_id", F.lit(5)).cast("string"), F.lit("/"))
    return e.select(
        F.concat(folder, F.col("event_type"), F.lit("_"), key.cast("string"), F.lit(".tif")).alias("path"),
        F.col("event_type").alias("band"), key.alias("frame_key"), F.col("value").alias("length"),
        F.col("ts").alias("modificationTime"), "event_id")


def done(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose length says they were processed."""
    return catalog(spark, sf).where(F.col("length") > 20).select("path").distinct()


# --- the same as SQL ------------------------------------------------------------------------------------------------------

_OFFSETS = f"(SELECT CAST(range AS INTEGER) AS o FROM range(0, {SIDE}, {S}))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "vec": ((), "SELECT vec_id // 100 AS image_id, CAST(vec_id % 100 AS INTEGER) AS slot, embedding, label FROM embeddings"),
    "images": ((), f"SELECT DISTINCT vec_id // 100 AS image_id, {SIDE} AS rows, {SIDE} AS cols FROM embeddings"),
    "px": (("vec",), """
        SELECT q.image_id, CAST((slot // 10) * 8 + p // 8 AS INTEGER) AS row, CAST((slot % 10) * 8 + p % 8 AS INTEGER) AS col,
          CASE WHEN label = 9 AND p < 4 THEN 0.0::DOUBLE ELSE floor((r[p + 1]::DOUBLE + 1) * 127.5::DOUBLE) END AS red,
          floor((g[p + 1]::DOUBLE + 1) * 127.5::DOUBLE) AS green, floor((b[p + 1]::DOUBLE + 1) * 127.5::DOUBLE) AS blue,
          CASE WHEN label = 9 AND p < 4 THEN 0.0::DOUBLE ELSE floor((n[p + 1]::DOUBLE + 1) * 127.5::DOUBLE) END AS infrared
        FROM (SELECT a.image_id, a.slot, a.label, a.embedding AS r, b.embedding AS g, c.embedding AS b, d.embedding AS n
              FROM vec a JOIN vec b ON b.image_id = a.image_id AND b.slot = (a.slot + 1) % 100
              JOIN vec c ON c.image_id = a.image_id AND c.slot = (a.slot + 2) % 100
              JOIN vec d ON d.image_id = a.image_id AND d.slot = (a.slot + 3) % 100) q,
             (SELECT range AS p FROM range(64))"""),
    "tiles": (("px",), f"""
        SELECT p.*, wc.o AS win_col, wr.o AS win_row FROM px p
        JOIN {_OFFSETS} wc ON p.col >= wc.o AND p.col < wc.o + {W}
        JOIN {_OFFSETS} wr ON p.row >= wr.o AND p.row < wr.o + {W}"""),
    "ztiles": (("tiles",), """
        SELECT image_id, win_col, win_row, row, col,
          (red - avg(red) OVER w) / (stddev_pop(red) OVER w + 1e-8) AS red,
          (green - avg(green) OVER w) / (stddev_pop(green) OVER w + 1e-8) AS green,
          (blue - avg(blue) OVER w) / (stddev_pop(blue) OVER w + 1e-8) AS blue,
          (infrared - avg(infrared) OVER w) / (stddev_pop(infrared) OVER w + 1e-8) AS infrared
        FROM tiles WINDOW w AS (PARTITION BY image_id, win_col, win_row)"""),
    "scored": (("ztiles",), """
        SELECT *, 1 / (1 + exp(-red)) AS seg, 1 / (1 + exp(-red)) / 16 - 0.02::DOUBLE AS dens FROM ztiles"""),
    "mosaic": (("scored",), """
        SELECT image_id, row, col, greatest(0, max(seg)) AS seg, greatest(0, max(dens)) AS dens
        FROM scored GROUP BY image_id, row, col"""),
    "tp": (("mosaic", "px"), """
        SELECT image_id, row, col, CASE WHEN red >= 128 THEN 1 ELSE 0 END AS truth,
          CASE WHEN round(seg, 9) >= 0.5 THEN 1 ELSE 0 END AS pred, seg AS score, dens,
          CASE WHEN blue >= 140 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, red / 4096 AS truth_dens
        FROM mosaic JOIN px USING (image_id, row, col)
        UNION ALL
        SELECT -1 - image_id, row, col, 0, 0, 0.0, 0.0, CASE WHEN blue >= 140 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END, 0.0 FROM px"""),
    "obj": (("px",), "SELECT image_id, row, col, CASE WHEN red >= 144 THEN 1 ELSE 0 END AS mask FROM px"),
    "big_px": ((), f"""
        SELECT g.image_id, g.row, g.col, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue,
          coalesce(infrared, 0) AS infrared
        FROM (SELECT image_id, CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col
              FROM (SELECT DISTINCT l_suppkey // 64 AS image_id FROM lineitem), range({BIG}) r, range({BIG}) c) g
        LEFT JOIN (SELECT l_suppkey // 64 AS image_id, CAST(l_partkey % {BIG} AS INTEGER) AS row,
                     CAST(l_orderkey % {BIG} AS INTEGER) AS col, max(l_quantity) AS red, max(l_discount * 100) AS green,
                     max(l_tax * 100) AS blue, max(l_extendedprice / 1000) AS infrared
                   FROM lineitem GROUP BY 1, 2, 3) i USING (image_id, row, col)"""),
    "crown": ((), """
        SELECT c_custkey AS id, c_mktsegment AS segment, sheet, cx - hw AS xmin, cx + hw AS xmax, cy - hh AS ymin, cy + hh AS ymax
        FROM (SELECT *, c_custkey // 1500 AS sheet, (c_custkey // 1500) * 250 + (c_custkey * 37 % 2500) / 10.0::DOUBLE AS cx,
                (c_custkey * 101 % 2500) / 10.0::DOUBLE AS cy, 1 + c_custkey % 4 AS hw, 1 + c_nationkey % 3 AS hh FROM customer)"""),
    "area": ((), """
        SELECT sheet * 25 + n AS id, sheet, x0::DOUBLE AS xmin, y0::DOUBLE AS ymin, (x0 + side)::DOUBLE AS xmax, (y0 + side)::DOUBLE AS ymax
        FROM (SELECT *, sheet * 250 + (n % 5) * 50 AS x0, (n // 5) * 50 AS y0, CASE WHEN n % 2 = 0 THEN 55 ELSE 45 END AS side
              FROM (SELECT DISTINCT c_custkey // 1500 AS sheet, c_nationkey AS n FROM customer))"""),
    "ext": ((), """
        SELECT s_suppkey AS image_id, x0::DOUBLE AS xmin, y0::DOUBLE AS ymin, (x0 + 60)::DOUBLE AS xmax, (y0 + 60)::DOUBLE AS ymax
        FROM (SELECT s_suppkey, (s_suppkey // 100) * 250 + s_suppkey * 53 % 200 AS x0, s_suppkey * 29 % 200 AS y0 FROM supplier)"""),
    "epx": ((), f"""
        SELECT s_suppkey AS image_id, CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col,
          ((s_suppkey * 31 + s_nationkey * 5 + r.range * 7 + c.range * 13) % 256)::DOUBLE AS red FROM supplier, range({EXTENT}) r, range({EXTENT}) c"""),
    "assigned": (("crown", "area"), """
        SELECT c.id AS polygon_id, min(a.id) AS area_id FROM crown c JOIN area a
          ON c.xmin <= a.xmax AND a.xmin <= c.xmax AND c.ymin <= a.ymax AND a.ymin <= c.ymax GROUP BY c.id"""),
    "frame": (("area",), """
        SELECT id AS frame_id, CAST(ymax - ymin AS INTEGER) AS rows, CAST(xmax - xmin AS INTEGER) AS cols, xmin AS x0, ymax AS y0 FROM area"""),
    "own": (("assigned", "crown", "frame"), """
        SELECT s.polygon_id, f.*, c.xmin, c.xmax, c.ymin, c.ymax, c.segment
        FROM assigned s JOIN crown c ON c.id = s.polygon_id JOIN frame f ON f.frame_id = s.area_id"""),
    "pts": (("own",), """
        SELECT frame_id, polygon_id, rows, cols, CAST(floor(y0 - round((ymin + ymax) / 2, 6)) AS INTEGER) AS row,
          CAST(floor(round((xmin + xmax) / 2, 6) - x0) AS INTEGER) AS col FROM own"""),
    "hits": (("area", "ext"), """
        SELECT a.id AS area_id, e.image_id, a.xmin AS area_xmin, a.ymin AS area_ymin, a.xmax AS area_xmax, a.ymax AS area_ymax,
          e.xmin AS image_xmin, e.ymin AS image_ymin, e.xmax AS image_xmax, e.ymax AS image_ymax
        FROM area a JOIN ext e ON a.xmin <= e.xmax AND e.xmin <= a.xmax AND a.ymin <= e.ymax AND e.ymin <= a.ymax"""),
    "cat": ((), """
        SELECT '/imagery/d' || CAST(user_id % 5 AS VARCHAR) || '/' || event_type || '_' || CAST(event_id // 10 AS VARCHAR) || '.tif' AS path,
          event_type AS band, event_id // 10 AS frame_key, value AS length, ts AS modificationTime, event_id FROM events"""),
    "done": (("cat",), "SELECT DISTINCT path FROM cat WHERE length > 20"),
}


def with_ctes(names: list[str], body: str, recursive: bool = False, extra: list[tuple[str, str]] | None = None) -> str:
    """``body`` behind the named fixture tables, what those need, and ``extra`` tables of the query itself."""
    ordered: list[str] = []

    def need(n: str) -> None:
        for d in CTES[n][0]:
            need(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered] + [f"{n} AS ({q.strip()})" for n, q in extra or []]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()
