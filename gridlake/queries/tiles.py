"""Queries over windows, patches, bands and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bands as fb
from ..operators import resample as rs, tiling as tl
from ..plans.inference import add_ndvi
from ..plans.training import epoch_steps
from ..schemas import WINDOW
from . import fixtures as fx
from .fixtures import S, SIDE, W, r6 as R, with_ctes
from .registry import query, r6

BANDS = ["red", "green", "blue", "infrared"]


# --- windows and patches ---------------------------------------------------------------------------


@query(with_ctes(["images"], f"""
    SELECT image_id, wc.o AS win_col, wr.o AS win_row, least({W}, cols - wc.o) AS w, least({W}, rows - wr.o) AS h,
      CAST((wc.o // {S}) * ((rows + {S} - 1) // {S}) + wr.o // {S} AS BIGINT) AS seq
    FROM images, {fx._OFFSETS} wc, {fx._OFFSETS} wr"""))
def window_grid(spark: SparkSession, sf: str) -> DataFrame:
    return tl.window_grid(fx.images(spark, sf), W, W, S)


@query(with_ctes(["tiles"], """
    SELECT image_id, win_col, win_row, count(*) AS n_px, sum(red) AS red, min(row) AS first_row, max(col) AS last_col
    FROM tiles GROUP BY ALL"""))
def tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf), W, W, S)
    return t.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("n_px"), F.sum("red").alias("red"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


@query(with_ctes(["tiles"], """
    SELECT image_id, win_col, win_row, sum(red) AS red, sum(red * row) AS red_row, sum(infrared * col) AS nir_col
    FROM tiles GROUP BY ALL"""))
def read_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows read from 16-pixel blocks give the same pixels as tiling."""
    blocks = tl.to_blocks(fx.pixels(spark, sf), BANDS, 16)
    px = tl.read_window(blocks, tl.window_grid(fx.images(spark, sf), W, W, S), BANDS, 16)
    return px.groupBy(*WINDOW).agg(
        F.sum("red").alias("red"), F.sum(F.col("red") * F.col("row")).alias("red_row"),
        F.sum(F.col("infrared") * F.col("col")).alias("nir_col"))


@query(with_ctes(["tiles"], f"""
    SELECT image_id, win_col, win_row, {W * W} AS n,
      sum(red * ((row - win_row) * {W} + (col - win_col) + 1)) AS red_at, sum(blue * ((row - win_row) * {W} + (col - win_col) + 1)) AS blue_at
    FROM tiles GROUP BY image_id, win_col, win_row"""))
def pad_patch(spark: SparkSession, sf: str) -> DataFrame:
    patches = tl.pad_patch(tl.tile_pixels(fx.pixels(spark, sf), W, W, S), ["red", "blue"], W, W)

    def weighted(b: str):
        return F.aggregate(F.transform(b, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v).alias(f"{b}_at")

    return patches.select(*WINDOW, F.size("red").alias("n"), weighted("red"), weighted("blue"))


_FRAMES_SQL = "SELECT image_id AS frame_id, rows, cols FROM images"


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return fx.images(spark, sf).withColumnRenamed("image_id", "frame_id")


@query(with_ctes(["images"], """
    SELECT frame_id, CAST(pr.range AS INTEGER) AS patch_row, CAST(pc.range AS INTEGER) AS patch_col
    FROM frames, range(0, 48, 12) pr, range(0, 48, 12) pc""", extra=[("frames", _FRAMES_SQL)]))
def sequential_patches(spark: SparkSession, sf: str) -> DataFrame:
    return tl.sequential_patches(_frames(spark, sf), W, 12).select("frame_id", "patch_row", "patch_col")


def _hash_sql(seed: str, *ids: str) -> str:
    text = " || '-' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query(with_ctes(["images"], f"""
    SELECT frame_id, CAST(s.range AS INTEGER) AS slot, CAST({_hash_sql('7r', '3', 'frame_id', 's.range')} % {SIDE - W} AS INTEGER) AS patch_row,
      CAST({_hash_sql('7c', '3', 'frame_id', 's.range')} % {SIDE - W} AS INTEGER) AS patch_col
    FROM frames, range(10) s""", extra=[("frames", _FRAMES_SQL)]))
def random_patches(spark: SparkSession, sf: str) -> DataFrame:
    return tl.random_patches(_frames(spark, sf), 10, W, 7, 3).select("frame_id", "slot", "patch_row", "patch_col")


@query(with_ctes(["images", "px"], f"""
    SELECT p.frame_id, slot, count(*) AS n_px, sum(red) AS red, sum(red * (row - patch_row)) AS red_row
    FROM (SELECT frame_id, CAST(s.range AS INTEGER) AS slot, {_hash_sql('7r', '3', 'frame_id', 's.range')} % {SIDE - W} AS patch_row,
            {_hash_sql('7c', '3', 'frame_id', 's.range')} % {SIDE - W} AS patch_col FROM frames, range(10) s) p
    JOIN px ON px.image_id = p.frame_id AND row >= patch_row AND row < patch_row + {W} AND col >= patch_col AND col < patch_col + {W}
    GROUP BY p.frame_id, slot""", extra=[("frames", _FRAMES_SQL)]))
def cut_random_patches(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf).withColumnRenamed("image_id", "frame_id").select("frame_id", "row", "col", "red")
    cut = tl.cut_patches(px, tl.random_patches(_frames(spark, sf), 10, W, 7, 3).drop("rows", "cols"), W)
    return cut.groupBy("frame_id", "slot").agg(
        F.count(F.lit(1)).alias("n_px"), F.sum("red").alias("red"), F.sum(F.col("red") * F.col("row")).alias("red_row"))


@query(with_ctes(["images"], f"""
    SELECT step, slot, frame_id, rows, cols
    FROM (SELECT CAST(i // 8 AS INTEGER) AS step, CAST(i % 8 AS INTEGER) AS slot, {_hash_sql('11f', '2', 'i // 8', 'i % 8')} % n AS frame_idx
          FROM (SELECT n, unnest(range(greatest(1, (n * 32 + 7) // 8) * 8)) AS i FROM (SELECT count(*) AS n FROM images))) d
    JOIN (SELECT image_id * 7 + 3 AS frame_id, row_number() OVER (ORDER BY image_id) - 1 AS frame_idx, rows, cols FROM images) USING (frame_idx)"""))
def sample_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose ids have gaps, 32 draws a frame."""
    frames = _frames(spark, sf).withColumn("frame_id", F.col("frame_id") * 7 + 3)
    return tl.sample_frames(frames, epoch_steps(frames.count(), 8, 32), 8, 11, 2).select("step", "slot", "frame_id", "rows", "cols")


@query(with_ctes(["px"], f"""
    SELECT p.image_id, p.row, p.col, p.red, {r6('h.height')} AS height FROM px p
    JOIN (SELECT image_id, row // 2 AS hr, col // 2 AS hc, avg(infrared) / 10 AS height FROM px GROUP BY 1, 2, 3) h
      ON h.image_id = p.image_id AND h.hr = p.row // 2 AND h.hc = p.col // 2"""))
def half_res_pair(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf)
    half = rs.downsample(px, 2, ["infrared"]).withColumn("height", F.col("infrared") / 10).drop("infrared")
    out = tl.half_res_pair(px.select("image_id", "row", "col", "red"), half)
    return out.withColumn("height", R("height"))


@query(with_ctes(["px"], "SELECT image_id, row, col, infrared, green FROM px"))
def select_bands(spark: SparkSession, sf: str) -> DataFrame:
    return tl.select_bands(fx.pixels(spark, sf), ["infrared", "green"])


@query(with_ctes(["images"], f"""
    SELECT image_id, win_col, win_row, seq // 4 AS batch, CAST(seq % 4 AS INTEGER) AS slot
    FROM (SELECT image_id, wc.o AS win_col, wr.o AS win_row,
            CAST((wc.o // {S}) * ((rows + {S} - 1) // {S}) + wr.o // {S} AS BIGINT) AS seq
          FROM images, {fx._OFFSETS} wc, {fx._OFFSETS} wr)"""))
def assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    grid = tl.window_grid(fx.images(spark, sf), W, W, S)
    return tl.assign_batches(grid, 4).select("image_id", "win_col", "win_row", "batch", "slot")


def _stats_sql(bands: list[str]) -> str:
    return ", ".join(
        f"{r6(f'avg({b})')} AS {b}_mean, {r6(f'stddev_pop({b})')} AS {b}_std, max({b}) AS {b}_max, max({b}) - min({b}) AS {b}_range"
        for b in bands)


@query(with_ctes(["tiles"], f"""
    SELECT image_id, win_col, win_row, count(*) AS n_px, {_stats_sql(['red', 'green'])}, {r6('sum(blue / 4096)')} AS object_count
    FROM tiles GROUP BY ALL"""))
def patch_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf), W, W, S).withColumn("density", F.col("blue") / 4096)
    out = tl.patch_stats(t, WINDOW, ["red", "green"], "density")
    rounded = [c for c in out.columns if c.endswith(("_mean", "_std")) or c == "object_count"]
    return out.withColumns({c: R(c) for c in rounded})


# --- bands ---------------------------------------------------------------------------------------------


@query(with_ctes(["px"], f"""
    SELECT image_id, {r6('avg(v) FILTER (NOT isnan(v))')} AS ndvi, count(*) FILTER (isnan(v)) AS n_nan, {r6('avg(gray)')} AS gray
    FROM (SELECT image_id, CASE WHEN infrared + red = 0 THEN 'NaN'::DOUBLE ELSE (infrared - red) / (infrared + red) END AS v,
            0.2989::DOUBLE * red + 0.5870::DOUBLE * green + 0.1140::DOUBLE * blue AS gray FROM px) GROUP BY image_id"""))
def ndvi_by_image(spark: SparkSession, sf: str) -> DataFrame:
    px = add_ndvi(fx.pixels(spark, sf)).withColumn("gray", fb.rgb_to_gray("red", "green", "blue"))
    return px.groupBy("image_id").agg(
        R(F.avg(F.when(~F.isnan("ndvi"), F.col("ndvi")))).alias("ndvi"),
        F.sum(F.isnan("ndvi").cast("long")).alias("n_nan"), R(F.avg("gray")).alias("gray"))


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, CASE WHEN infrared + red = 0 THEN NULL ELSE {r6('(infrared - red) / (infrared + red)')} END AS ndvi FROM px"""))
def ndvi_pixels(spark: SparkSession, sf: str) -> DataFrame:
    px = add_ndvi(fx.pixels(spark, sf))
    return px.select("image_id", "row", "col", F.when(~F.isnan("ndvi"), R("ndvi")).alias("ndvi"))


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, {r6('0.2989::DOUBLE * red + 0.5870::DOUBLE * green + 0.1140::DOUBLE * blue')} AS gray FROM px"""))
def rgb_to_gray(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pixels(spark, sf).select("image_id", "row", "col", R(fb.rgb_to_gray("red", "green", "blue")).alias("gray"))


@query(with_ctes(["ztiles"], f"""
    SELECT image_id, win_col, win_row, row, col, {r6('red')} AS red, {r6('infrared')} AS infrared FROM ztiles"""))
def normalize_patch(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf), W, W, S)
    out = fb.normalize_patch(t.select(*WINDOW, "row", "col", "red", "infrared"), WINDOW, ["red", "infrared"])
    return out.select(*WINDOW, "row", "col", R("red").alias("red"), R("infrared").alias("infrared"))


@query(with_ctes(["ztiles"], f"""
    SELECT image_id, win_col, win_row, count(*) AS n_px, {_stats_sql(['red', 'blue']).replace('max(red) -', 'max(red) -')}
    FROM (SELECT image_id, win_col, win_row, round(red, 6) AS red, round(blue, 6) AS blue FROM ztiles) GROUP BY ALL"""))
def normalize_patch_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf), W, W, S).select(*WINDOW, "row", "col", "red", "blue")
    z = fb.normalize_patch(t, WINDOW, ["red", "blue"]).withColumns({"red": R("red"), "blue": R("blue")})
    out = tl.patch_stats(z, WINDOW, ["red", "blue"])
    return out.withColumns({c: R(c) for c in out.columns if c.endswith(("_mean", "_std"))})


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, {r6('(red - avg(red) OVER w) / stddev_pop(red) OVER w')} AS red,
      {r6('(blue - avg(blue) OVER w) / stddev_pop(blue) OVER w')} AS blue FROM px WINDOW w AS (PARTITION BY image_id)"""))
def normalize_tile(spark: SparkSession, sf: str) -> DataFrame:
    out = fb.normalize_tile(fx.pixels(spark, sf), ["red", "blue"])
    return out.select("image_id", "row", "col", R("red").alias("red"), R("blue").alias("blue"))


def _preset_sql(name: str, columns: dict[str, str]) -> str:
    p = fb.PRESETS[name]
    cells = [
        f"{r6(f'({columns.get(b, b)} / {p.scale!r}::DOUBLE - {m!r}::DOUBLE) / {d!r}::DOUBLE')} AS {b}"
        for b, m, d in zip(p.bands, p.mean, p.divisor)
    ]
    missing = [f"NULL::DOUBLE AS {b}" for b in ["red", "green", "blue", "infrared", "ndvi"] if b not in p.bands]
    return f"SELECT '{name}' AS preset, image_id, row, col, {', '.join(cells + missing)} FROM s"


_IMAGE_PRESETS = [n for n, p in fb.PRESETS.items() if "height" not in p.bands]


@query(with_ctes(["px"], " UNION ALL BY NAME ".join(_preset_sql(n, {}) for n in _IMAGE_PRESETS), extra=[
    ("s", "SELECT *, (infrared - red) / (infrared + red + 1) AS ndvi FROM px")]))
def normalize_global(spark: SparkSession, sf: str) -> DataFrame:
    """Every preset on every pixel."""
    ratio = (F.col("infrared") - F.col("red")) / (F.col("infrared") + F.col("red") + 1)
    px = fx.pixels(spark, sf).withColumn("ndvi", ratio)
    names = ["red", "green", "blue", "infrared", "ndvi"]
    out = None
    for n in _IMAGE_PRESETS:
        used = fb.PRESETS[n].bands
        part = fb.normalize_global(px, n).select(
            F.lit(n).alias("preset"), "image_id", "row", "col",
            *[(R(b) if b in used else F.lit(None).cast("double")).alias(b) for b in names])
        out = part if out is None else out.unionByName(part)
    return out


@query(with_ctes(["tiles"], f"""
    SELECT t.image_id, t.win_col, t.win_row, row, col, {r6('(red - q[1]) / (q[2] - q[1])')} AS red
    FROM tiles t JOIN (SELECT image_id, win_col, win_row, quantile_cont(red, [0.25, 0.75]) AS q FROM tiles GROUP BY ALL) s
      ON s.image_id = t.image_id AND s.win_col = t.win_col AND s.win_row = t.win_row"""))
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf).select("image_id", "row", "col", "red"), W, W, S)
    return fb.robust_scale_local(t, WINDOW, ["red"]).withColumn("red", R("red"))


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, {r6('(red - 120) / (136 - 120)')} AS red, {r6('(blue - 119.5::DOUBLE) / 17')} AS blue FROM px"""))
def robust_scale_given(spark: SparkSession, sf: str) -> DataFrame:
    out = fb.robust_scale_global(fx.pixels(spark, sf), {"red": (120.0, 136.0), "blue": (119.5, 136.5)})
    return out.select("image_id", "row", "col", R("red").alias("red"), R("blue").alias("blue"))


@query(with_ctes(["px"], " UNION ALL ".join(
    f"SELECT '{b}' AS band, quantile_cont({b}, 0.25) AS q1, quantile_cont({b}, 0.75) AS q3 FROM px" for b in BANDS)))
def global_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return fb.global_quartiles(fx.pixels(spark, sf), BANDS)


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col,
      {r6('255 * (green - min(green) OVER w) / (max(green) OVER w - min(green) OVER w)')} AS green,
      {r6('139 + 116 * (infrared - min(infrared) OVER w) / (max(infrared) OVER w - min(infrared) OVER w)')} AS infrared
    FROM px WINDOW w AS (PARTITION BY image_id)"""))
def minmax_rescale(spark: SparkSession, sf: str) -> DataFrame:
    out = fb.minmax_rescale(fx.pixels(spark, sf), ["image_id"])
    return out.select("image_id", "row", "col", R("green").alias("green"), R("infrared").alias("infrared"))


@query(with_ctes(["tiles"], f"""
    SELECT image_id, win_col, win_row, row, col, {r6('(red / 255 - avg(red / 255) OVER w) / (stddev_pop(red / 255) OVER w + 1e-8)')} AS red
    FROM tiles WINDOW w AS (PARTITION BY image_id, win_col, win_row)"""))
def unit_scale_then_zscore(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf).select("image_id", "row", "col", "red"), W, W, S)
    return fb.unit_scale_then_zscore(t, WINDOW, ["red"]).withColumn("red", R("red"))


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, CASE WHEN infrared / 100 < 1 THEN 0.0 ELSE {r6('infrared / 100')} END AS detected,
      {r6('infrared / 97.19::DOUBLE')} AS unit, {r6('infrared * 97.19::DOUBLE')} AS metres, infrared * 100 AS centi, infrared * 10000 AS fixed FROM px"""))
def height_scale(spark: SparkSession, sf: str) -> DataFrame:
    modes = ["detected", "unit", "metres", "centi", "fixed"]
    return fx.pixels(spark, sf).select("image_id", "row", "col", *[R(fb.height_scale("infrared", m)).alias(m) for m in modes])


@query(with_ctes(["tiles"], f"""
    SELECT image_id, win_col, win_row, row, col,
      CASE WHEN {_hash_sql('5', 'image_id', 'win_col', 'win_row')} / 4294967296.0::DOUBLE <= 0.4::DOUBLE
        THEN {r6('(red - avg(red) OVER w) / (stddev_pop(red) OVER w + 1e-8)')} ELSE red END AS red
    FROM tiles WINDOW w AS (PARTITION BY image_id, win_col, win_row)"""))
def maybe_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf).select("image_id", "row", "col", "red"), W, W, S)
    return fb.maybe_normalize(t, 0.4, 5, WINDOW, ["red"]).select(*WINDOW, "row", "col", R("red").alias("red"))


@query(with_ctes(["mosaic"], f"""
    SELECT image_id, row, col, CASE WHEN round(seg, 9) >= 0.5 THEN 1 ELSE 0 END AS mask, {r6('greatest(dens - 0.01::DOUBLE, 0)')} AS dens,
      CAST(trunc(least(255, greatest(0, round(dens * 10000, 6)))) AS SMALLINT) AS u8,
      CAST(trunc(least(32767, greatest(-32768, round(seg * 100000 - 40000, 6)))) AS SMALLINT) AS i16 FROM mosaic"""))
def threshold_clip_cast(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.inference import score_mosaic

    m = score_mosaic(fx.pixels(spark, sf), [fx.RED], W, W, S)
    return m.select(
        "image_id", "row", "col", fb.threshold(F.round("seg", 9)).alias("mask"),
        R(fb.clip_negative(F.col("dens") - F.lit(0.01))).alias("dens"),
        fb.cast_dtype(R(F.col("dens") * 10000), "uint8").alias("u8"),
        fb.cast_dtype(R(F.col("seg") * 100000 - 40000), "int16").alias("i16"))


# --- resampling -------------------------------------------------------------------------------------------


def _axis_sql(n: int, out: int, source: str) -> str:
    """(p, i, w): weights of input i for output p, clamped at the edge."""
    return f"""SELECT p, CAST(i AS INTEGER) AS i, sum(w) AS w FROM (
        SELECT p, greatest(0, least({n - 1}, floor(s))) AS i, 1 - (s - floor(s)) AS w FROM (SELECT CAST(range AS INTEGER) AS p, {source} AS s FROM range({out}))
        UNION ALL SELECT p, greatest(0, least({n - 1}, floor(s) + 1)), s - floor(s) FROM (SELECT CAST(range AS INTEGER) AS p, {source} AS s FROM range({out})))
      GROUP BY ALL"""


_GATHER = """
    SELECT image_id, r.p AS row, c.p AS col, (round(sum(red * r.w * c.w), 6) + 0.0::DOUBLE) AS red
    FROM px JOIN ax r ON px.row = r.i JOIN ax c ON px.col = c.i GROUP BY image_id, r.p, c.p"""


@query(with_ctes(["px"], _GATHER, extra=[("ax", _axis_sql(SIDE, 2 * SIDE, "(range + 0.5::DOUBLE) / 2 - 0.5::DOUBLE"))]))
def resample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.sized_pixels(spark, sf).select("image_id", "row", "col", "rows", "cols", "red")
    return rs.resample_bilinear(px, 2, ["red"]).select("image_id", "row", "col", R("red").alias("red"))


@query(with_ctes(["px"], _GATHER, extra=[
    ("ax", _axis_sql(SIDE, 2 * SIDE, f"range * ({SIDE - 1} / {2 * SIDE - 1}::DOUBLE)"))]))
def zoom_mask(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.sized_pixels(spark, sf).select("image_id", "row", "col", "rows", "cols", "red")
    return rs.zoom_mask(px, 2, ["red"]).select("image_id", "row", "col", R("red").alias("red"))


@query(with_ctes(["px"], f"""
    SELECT image_id, row // 2 AS row, col // 2 AS col, {r6('avg(red) / 4096 * 4')} AS density FROM px GROUP BY ALL"""))
def downsample_mass(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.pixels(spark, sf).select("image_id", "row", "col", (F.col("red") / 4096).alias("density"))
    out = rs.mass_preserving_rescale(rs.downsample(d, 2, ["density"]), 2, "density", "down")
    return out.withColumn("density", R("density"))


@query(with_ctes(["px"], f"""
    SELECT image_id, {r6('sum(red) / 4096')} AS before, {r6('sum(red) / 4096')} AS after FROM px GROUP BY image_id"""))
def upsample_mass(spark: SparkSession, sf: str) -> DataFrame:
    """The integral of a density survives up-sampling."""
    d = fx.sized_pixels(spark, sf).select("image_id", "row", "col", "rows", "cols", (F.col("red") / 4096).alias("density"))
    up = rs.mass_preserving_rescale(rs.resample_bilinear(d, 2, ["density"]), 2, "density", "up")
    sums = d.select("image_id", F.col("density").alias("before"), F.lit(0.0).alias("after")).unionByName(
        up.select("image_id", F.lit(0.0).alias("before"), F.col("density").alias("after")))
    return sums.groupBy("image_id").agg(R(F.sum("before")).alias("before"), R(F.sum("after")).alias("after"))


