"""Queries over scoring, ensembles, mosaics and whole inference runs."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bands import normalize_patch
from ..operators import mosaic as mo, scoring as sc, tiling as tl
from ..operators.objects import PIXEL_AREA
from ..plans import block_inference as bi, inference as inf
from ..schemas import WINDOW
from . import fixtures as fx
from .fixtures import S, SIDE, W, r6 as R, with_ctes
from .registry import query, r6


def _ztiles(spark: SparkSession, sf: str, bands: list[str]) -> DataFrame:
    t = tl.tile_pixels(fx.pixels(spark, sf).select("image_id", "row", "col", *bands), W, W, S)
    return normalize_patch(t, WINDOW, bands)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score_linear(_ztiles(spark, sf, ["red"]), fx.RED).select(*WINDOW, "row", "col", "seg", "dens")


_FOLD = """list_reduce(list_prepend(0.0::DOUBLE, list(seg ORDER BY win_col, win_row)),
  lambda a, v: CASE WHEN (CASE WHEN a <> 0 THEN a * 0.5 + v * 0.5 ELSE a END) = 0 THEN v
    ELSE a * 0.5 + v * 0.5 END)"""


# --- flagship -------------------------------------------------------------------------------------------------

_REPORT = f"""
    SELECT image_id, CAST(sum(mask) AS BIGINT) AS mask_px, {r6('sum(greatest(dens, 0))')} AS n_objects, count(*) AS n_px,
      {r6(f'sum(greatest(dens, 0)) / (count(*) * {PIXEL_AREA}::DOUBLE) * 10000')} AS per_ha
    FROM (SELECT *, CASE WHEN round(seg, 9) >= 0.5 THEN 1 ELSE 0 END AS mask FROM mosaic) GROUP BY image_id"""


def report(mosaicked: DataFrame) -> DataFrame:
    found = inf.detect(mosaicked.withColumn("seg", F.round("seg", 9)))
    out = inf.image_report(found, PIXEL_AREA)
    return out.select("image_id", "mask_px", R("n_objects").alias("n_objects"), "n_px", R("per_ha").alias("per_ha"))


@query(with_ctes(["mosaic"], _REPORT))
def tile_score_count(spark: SparkSession, sf: str) -> DataFrame:
    """How many objects per image and per hectare does a scorer find?"""
    return report(inf.score_mosaic(fx.pixels(spark, sf), [fx.RED], W, W, S))


@query(with_ctes(["mosaic"], _REPORT))
def tile_score_count_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """The same with one row per (pixel, window)."""
    return report(inf.score_mosaic_tiled(fx.pixels(spark, sf), [fx.RED], W, W, S))


# --- models -------------------------------------------------------------------------------------------------------


def _model_sql(m: sc.LinearModel, bands: dict[str, str]) -> str:
    z = " + ".join([f"{m.bias!r}::DOUBLE", *[f"{w!r}::DOUBLE * {bands.get(b, b)}" for b, w in zip(m.bands, m.weights)]])
    return f"1 / (1 + exp(-({z})))"


# a band with NaN anywhere in a window is NaN in all of it, so NaN and its own count stand for the z-score
_NDVI_TILES = ("nz", """
    SELECT *, CASE WHEN max(CASE WHEN isnan(ndvi) THEN 1 ELSE 0 END) OVER w = 1 THEN 'NaN'::DOUBLE
      ELSE (ndvi - avg(ndvi) OVER w) / (stddev_pop(CASE WHEN isnan(ndvi) THEN 0 ELSE ndvi END) OVER w + 1e-8) END AS zndvi
    FROM (SELECT z.*, CASE WHEN t.infrared + t.red = 0 THEN 'NaN'::DOUBLE ELSE (t.infrared - t.red) / (t.infrared + t.red) END AS ndvi
          FROM ztiles z JOIN tiles t USING (image_id, win_col, win_row, row, col))
    WINDOW w AS (PARTITION BY image_id, win_col, win_row)""")

_MODELS = ("ms", " UNION ALL ".join(
    f"SELECT '{m.name}' AS model_id, image_id, win_col, win_row, row, col, {_model_sql(m, {'ndvi': 'zndvi'})} AS seg FROM nz"
    for m in fx.ENSEMBLE))

_ENSEMBLE = ("ens", """
    SELECT image_id, win_col, win_row, row, col, coalesce(avg(seg) FILTER (NOT isnan(seg)), 'NaN'::DOUBLE) AS seg,
      coalesce(avg(seg / 16 - 0.02::DOUBLE) FILTER (NOT isnan(seg)), 'NaN'::DOUBLE) AS dens
    FROM ms GROUP BY ALL""")


def _each_model(spark: SparkSession, sf: str) -> DataFrame:
    bands = ["red", "green", "blue", "infrared", "ndvi"]
    t = tl.tile_pixels(inf.add_ndvi(fx.pixels(spark, sf)), W, W, S)
    return sc.score_each_model(normalize_patch(t, WINDOW, bands), fx.ENSEMBLE)


@query(with_ctes(["ztiles", "tiles"], f"""
    SELECT model_id, image_id, count(*) AS n, count(*) FILTER (isnan(seg)) AS n_nan, {r6('sum(seg) FILTER (NOT isnan(seg))')} AS seg
    FROM ms GROUP BY ALL""", extra=[_NDVI_TILES, _MODELS]))
def score_each_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every model on every window, with the windows NaN makes useless for one of them."""
    nan = F.isnan("seg")
    return _each_model(spark, sf).groupBy("model_id", "image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(nan.cast("long")).alias("n_nan"),
        R(F.sum(F.when(~nan, F.col("seg")))).alias("seg"))


@query(with_ctes(["ztiles", "tiles"], f"""
    SELECT image_id, win_col, win_row, row, col, {r6('seg')} AS seg, {r6('dens')} AS dens FROM ens""",
                 extra=[_NDVI_TILES, _MODELS, _ENSEMBLE]))
def ensemble_nanmean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the models' rows that are not NaN."""
    out = sc.ensemble_nanmean(_each_model(spark, sf), [*WINDOW, "row", "col"], ["seg", "dens"])
    return out.select(*WINDOW, "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


@query(with_ctes(["ztiles", "tiles"], f"""
    SELECT image_id, row, col, {r6('greatest(0, max(seg))')} AS seg, {r6('greatest(0, max(dens))')} AS dens
    FROM ens GROUP BY image_id, row, col""", extra=[_NDVI_TILES, _MODELS, _ENSEMBLE]))
def ensemble_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """Three models, nanmean, MAX mosaic, without a row per (pixel, window)."""
    out = inf.score_mosaic(inf.add_ndvi(fx.pixels(spark, sf)), fx.ENSEMBLE, W, W, S)
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


@query(with_ctes(["ztiles", "tiles"], f"""
    SELECT image_id, row, col, {r6('greatest(0, max(seg))')} AS seg, {r6('greatest(0, max(dens))')} AS dens
    FROM ens GROUP BY image_id, row, col""", extra=[_NDVI_TILES, _MODELS, _ENSEMBLE]))
def ensemble_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same three models as Python callables on block arrays, each with its own bands."""
    models = [bi.BandModel(m.name, m.bands, m.scorer) for m in fx.ENSEMBLE]
    bands = sorted({b for m in models for b in m.bands})
    blocks = tl.to_blocks(inf.add_ndvi(fx.pixels(spark, sf)), bands, 32)
    out = tl.from_blocks(bi.score_blocks(blocks, fx.images(spark, sf), models, 32, W, W, S), ["seg", "dens"])
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


@query(with_ctes(["ztiles", "tiles"], """
    SELECT model_id, image_id, row, col, CASE WHEN isnan(seg) THEN -1 ELSE (round(seg, 6) + 0.0::DOUBLE) END AS seg
    FROM (SELECT model_id, image_id, row, col, greatest(0, max(seg)) AS seg FROM ms GROUP BY model_id, image_id, row, col)""", extra=[_NDVI_TILES, _MODELS]))
def each_model_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same on block arrays with one result a model; -1 where a model has no number."""
    models = [bi.BandModel(m.name, m.bands, m.scorer) for m in fx.ENSEMBLE]
    bands = sorted({b for m in models for b in m.bands})
    blocks = tl.to_blocks(inf.add_ndvi(fx.pixels(spark, sf)), bands, 32)
    scored = bi.score_blocks(blocks, fx.images(spark, sf), models, 32, W, W, S, each_model=True)
    px = scored.select("model_id", F.explode(F.arrays_zip("rows", "cols", "seg")).alias("p"), "image_id")
    seg = F.col("p.seg")
    return px.select("model_id", "image_id", F.col("p.rows").alias("row"), F.col("p.cols").alias("col"),
                     F.when(F.isnan(seg), F.lit(-1.0)).otherwise(R(seg)).alias("seg"))


def _red_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return tl.to_blocks(fx.pixels(spark, sf).select("image_id", "row", "col", "red"), ["red"], 32)


@query(with_ctes(["scored"], f"""
    SELECT image_id, row, col, {r6(_FOLD)} AS seg
    FROM scored GROUP BY image_id, row, col"""))
def mix_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered merge on block arrays."""
    model = bi.BandModel("red", ("red",), fx.RED.scorer)
    out = tl.from_blocks(bi.score_blocks(_red_blocks(spark, sf), fx.images(spark, sf), [model], 32, W, W, S, "MIX"), ["seg"])
    return out.select("image_id", "row", "col", R("seg").alias("seg"))


# --- two resolutions -----------------------------------------------------------------------------------------------------

_HALF = ("half", "SELECT image_id, row // 2 AS hr, col // 2 AS hc, avg(infrared) AS height FROM px GROUP BY 1, 2, 3")


def _half_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.resample import downsample

    half = downsample(fx.pixels(spark, sf), 2, ["infrared"]).withColumnRenamed("infrared", "height")
    return tl.to_blocks(half, ["height"], 16)


def _both_scorer():
    def run(x: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seg = 1 / (1 + np.exp(-(x[..., 0] + (np.repeat(np.repeat(half[..., 0], 2, axis=1), 2, axis=2) - 128) / 100)))
        return seg, seg / 16 - 0.02

    return run


@query(with_ctes(["ztiles", "px"], f"""
    SELECT image_id, row, col, {r6('greatest(0, max(seg))')} AS seg, {r6('greatest(0, max(seg / 16 - 0.02::DOUBLE))')} AS dens FROM (
      SELECT z.image_id, z.row, z.col, 1 / (1 + exp(-(z.red + (h.height - 128) / 100))) AS seg FROM ztiles z
      JOIN half h ON h.image_id = z.image_id AND h.hr = z.row // 2 AND h.hc = z.col // 2) GROUP BY image_id, row, col""", extra=[_HALF]))
def two_resolution_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A network with a full- and a half-resolution input over whole rasters, merged."""
    model = bi.BandModel("both", ("red",), _both_scorer, ("height",))
    scored = bi.score_blocks(_red_blocks(spark, sf), fx.images(spark, sf), [model], 32, W, W, S, half_blocks=_half_blocks(spark, sf))
    out = tl.from_blocks(scored, ["seg", "dens"])
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


def _height_scorer():
    def run(x: np.ndarray, half: np.ndarray) -> tuple[np.ndarray]:
        n, h, w, _ = x.shape
        return (x[..., 0].reshape(n, h // 2, 2, w // 2, 2).mean(axis=(2, 4)) + half[..., 0] / 100,)

    return run


_HEIGHTS = ("hs", """
    SELECT z.image_id, win_col, win_row, z.row // 2 AS row, z.col // 2 AS col, avg(z.red) + max(h.height) / 100 AS seg FROM ztiles z
    JOIN half h ON h.image_id = z.image_id AND h.hr = z.row // 2 AND h.hc = z.col // 2 GROUP BY 1, 2, 3, 4, 5""")


@query(with_ctes(["ztiles", "px"], f"""
    SELECT image_id, row, col, {r6(_FOLD)} AS height
    FROM hs GROUP BY image_id, row, col""", extra=[_HALF, _HEIGHTS]))
def height_blocks_mix(spark: SparkSession, sf: str) -> DataFrame:
    """A height head at half the resolution, blended window by window on a canvas of half the size."""
    model = bi.BandModel("height", ("red",), _height_scorer, ("height",))
    out = bi.score_height_blocks(_red_blocks(spark, sf), _half_blocks(spark, sf), fx.images(spark, sf), [model], 32, W, W, S)
    return tl.from_blocks(out, ["height"]).select("image_id", "row", "col", R("height").alias("height"))


_FINE = [("ax", f"""
    SELECT p, CAST(i AS INTEGER) AS i, sum(w) AS w FROM (
      SELECT p, greatest(0, least({SIDE - 1}, floor(s) + k)) AS i, CASE WHEN k = 1 THEN s - floor(s) ELSE 1 - (s - floor(s)) END AS w
      FROM (SELECT CAST(range AS INTEGER) AS p, (range + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS s FROM range({2 * SIDE})), (SELECT range AS k FROM range(2))) GROUP BY ALL"""),
    ("fine", "SELECT image_id, r.p AS row, c.p AS col, sum(red * r.w * c.w) AS red FROM px JOIN ax r ON px.row = r.i JOIN ax c ON px.col = c.i GROUP BY 1, 2, 3"),
    ("fo", f"SELECT CAST(range AS INTEGER) AS o FROM range(0, {SIDE}, {S})"),
    ("fz", f"""
    SELECT f.image_id, wc.o AS win_col, wr.o AS win_row, f.row, f.col, (red - avg(red) OVER w) / (stddev_pop(red) OVER w + 1e-8) AS red FROM fine f
    JOIN fo wc ON f.col >= 2 * wc.o AND f.col < 2 * (wc.o + {W}) JOIN fo wr ON f.row >= 2 * wr.o AND f.row < 2 * (wr.o + {W})
    WINDOW w AS (PARTITION BY f.image_id, wc.o, wr.o)"""),
    ("fs", """
    SELECT image_id, win_col, win_row, row // 2 AS row, col // 2 AS col, avg(1 / (1 + exp(-red))) AS seg, 4 * avg(1 / (1 + exp(-red)) / 16 - 0.02::DOUBLE) AS dens
    FROM fz GROUP BY 1, 2, 3, 4, 5""")]


@query(with_ctes(["px"], f"""
    SELECT image_id, count(*) AS n_px, {r6('sum(seg)')} AS seg, {r6('sum(dens)')} AS n_objects
    FROM (SELECT image_id, row, col, greatest(0, max(seg)) AS seg, greatest(0, max(dens)) AS dens FROM fs GROUP BY 1, 2, 3) GROUP BY image_id""", extra=_FINE))
def upscaled_score_count(spark: SparkSession, sf: str) -> DataFrame:
    """Objects per image with a network that wants pixels half as wide."""
    model = bi.BandModel("red", ("red",), fx.RED.scorer)
    scored = bi.score_blocks(_red_blocks(spark, sf), fx.images(spark, sf), [model], 32, W, W, S, upscale=2)
    return tl.from_blocks(scored, ["seg", "dens"]).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_px"), R(F.sum("seg")).alias("seg"), R(F.sum("dens")).alias("n_objects"))


@query(with_ctes(["px"], """
    SELECT 'a' AS model_id, image_id, row, col, 3 AS n, red + 2 * green + 3 * blue AS x FROM px
    UNION ALL SELECT 'b', image_id, row, col, 2, infrared + 2 * red FROM px"""))
def route_bands(spark: SparkSession, sf: str) -> DataFrame:
    models = {"a": ["red", "green", "blue"], "b": ["infrared", "red"]}
    out = sc.route_bands(models, fx.pixels(spark, sf), ["red", "green", "blue", "infrared"])
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("model_id", "image_id", "row", "col", F.size("x").alias("n"), weighted.alias("x"))


@query(with_ctes(["mosaic"], f"SELECT image_id, row, col, {r6('seg')} AS seg, {r6('dens')} AS dens FROM mosaic"))
def score_python_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model given as a Python callable on padded patches, batches of 3."""
    out = inf.score_mosaic_model(
        fx.pixels(spark, sf), fx.images(spark, sf), fx.RED.scorer, ["red"], W, W, S, batch_rows=3)
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


def _two_input_scorer():
    def run(x: np.ndarray, half: np.ndarray) -> tuple[np.ndarray]:
        return (x[..., 0] + 2 * np.repeat(np.repeat(half[..., 0], 2, axis=1), 2, axis=2),)

    return run


@query(with_ctes(["px"], f"""
    SELECT t.image_id, t.win_col, t.win_row, t.row, t.col, {r6('t.red + 2 * h.height')} AS height FROM (
      SELECT p.*, wc.o AS win_col, wr.o AS win_row FROM px p
      JOIN (SELECT CAST(range AS INTEGER) AS o FROM range(0, {SIDE}, 16)) wc ON p.col >= wc.o AND p.col < wc.o + 16
      JOIN (SELECT CAST(range AS INTEGER) AS o FROM range(0, {SIDE}, 16)) wr ON p.row >= wr.o AND p.row < wr.o + 16) t
    JOIN (SELECT image_id, row // 2 AS hr, col // 2 AS hc, avg(infrared) AS height FROM px GROUP BY 1, 2, 3) h
      ON h.image_id = t.image_id AND h.hr = t.row // 2 AND h.hc = t.col // 2"""))
def score_two_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """A model with a full- and a half-resolution input per window."""
    from ..operators.resample import downsample

    px = fx.pixels(spark, sf)
    full = tl.pad_patch(tl.tile_pixels(px, 16, 16, 16), ["red"], 16, 16)
    half_px = downsample(px, 2, ["infrared"]).withColumnRenamed("infrared", "height")
    half = tl.tile_pixels(half_px, 8, 8, 8)
    half = tl.pad_patch(half, ["height"], 8, 8).withColumns({"win_col": F.col("win_col") * 2, "win_row": F.col("win_row") * 2})
    scored = sc.score_two_inputs(full.join(half, WINDOW), _two_input_scorer, ["red"], ["height"], 16, 16, heads=("height",))
    return sc.unpatch(scored, 16, ("height",)).withColumn("height", R("height"))


# --- merges ----------------------------------------------------------------------------------------------------------

_SEG_DENS = f"{r6('seg')} AS seg, {r6('dens')} AS dens"


def _merge(op: str, init: float, spark: SparkSession, sf: str) -> DataFrame:
    out = mo.mosaic(_scored(spark, sf), op, ["seg", "dens"], init=init)
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


def _merge_sql(seg: str) -> str:
    return f"""SELECT image_id, row, col, {r6(seg)} AS seg, {r6(seg.replace('seg', 'dens'))} AS dens
    FROM scored GROUP BY image_id, row, col"""



query(with_ctes(["scored"], _merge_sql("greatest(0, max(seg))")), "mosaic_max")(partial(_merge, "MAX", 0.0))
query(with_ctes(["scored"], _merge_sql("least(1, min(seg))")), "mosaic_min")(partial(_merge, "MIN", -1.0))
query(with_ctes(["scored"], _merge_sql("arg_max(seg, win_col * 1000 + win_row)")), "mosaic_replace")(
    partial(_merge, "REPLACE", 0.0))
query(with_ctes(["scored"], _merge_sql(_FOLD)), "mosaic_mix")(partial(_merge, "MIX", 0.0))


@query(with_ctes(["scored"], f"""
    SELECT image_id, row, col, {r6('greatest(0, max(CASE WHEN rim THEN 0 ELSE seg END))')} AS seg,
      {r6('greatest(0, max(CASE WHEN rim THEN 0 ELSE dens END))')} AS dens
    FROM (SELECT *, row - win_row < 5 OR col - win_col < 5 OR row - win_row >= least({W}, {SIDE} - win_row) - 5
            OR col - win_col >= least({W}, {SIDE} - win_col) - 5 AS rim FROM scored) GROUP BY image_id, row, col"""))
def border_suppressed_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    out = mo.apply_mosaic(_scored(spark, sf), "MAX", ["seg", "dens"], W, W, 5, fx.images(spark, sf))
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


def _fused(op: str, border: int, spark: SparkSession, sf: str) -> DataFrame:
    out = inf.score_mosaic(fx.pixels(spark, sf), [fx.RED], W, W, S, op, border, images=fx.images(spark, sf))
    return out.select("image_id", "row", "col", R("seg").alias("seg"), R("dens").alias("dens"))


query(with_ctes(["scored"], _merge_sql(_FOLD)), "fused_mosaic_mix")(partial(_fused, "MIX", 0))
query(with_ctes(["scored"], _merge_sql("arg_max(seg, win_col * 1000 + win_row)")), "fused_mosaic_replace")(
    partial(_fused, "REPLACE", 0))
query(with_ctes(["scored"], _merge_sql("least(0, min(seg))")), "fused_mosaic_min")(partial(_fused, "MIN", 0))
query(with_ctes(["scored"], f"""
    SELECT image_id, row, col, {r6('greatest(0, max(CASE WHEN rim THEN 0 ELSE seg END))')} AS seg,
      {r6('greatest(0, max(CASE WHEN rim THEN 0 ELSE dens END))')} AS dens
    FROM (SELECT *, row - win_row < 5 OR col - win_col < 5 OR row - win_row >= least({W}, {SIDE} - win_row) - 5
            OR col - win_col >= least({W}, {SIDE} - win_col) - 5 AS rim FROM scored) GROUP BY image_id, row, col"""),
      "fused_border_mosaic")(partial(_fused, "MAX", 5))


# --- big raster ----------------------------------------------------------------------------------------------------------

_BIG_W, _BIG_S = 128, 64

_BIG = [
    ("bo", f"SELECT CAST(range AS INTEGER) AS o FROM range(0, {fx.BIG}, {_BIG_S})"),
    ("bt", f"""SELECT p.*, wc.o AS win_col, wr.o AS win_row FROM big_px p JOIN bo wc ON p.col >= wc.o AND p.col < wc.o + {_BIG_W}
      JOIN bo wr ON p.row >= wr.o AND p.row < wr.o + {_BIG_W}"""),
    ("bz", """SELECT t.image_id, t.row, t.col, (red - rm) / (rs + 1e-8) AS red, (green - gm) / (gs + 1e-8) AS green,
        (blue - bm) / (bs + 1e-8) AS blue, (infrared - nm) / (ns + 1e-8) AS infrared
      FROM bt t JOIN (SELECT image_id, win_col, win_row, avg(red) AS rm, stddev_pop(red) AS rs, avg(green) AS gm,
          stddev_pop(green) AS gs, avg(blue) AS bm, stddev_pop(blue) AS bs, avg(infrared) AS nm, stddev_pop(infrared) AS ns
        FROM bt GROUP BY ALL) s USING (image_id, win_col, win_row)"""),
    ("bs", f"SELECT image_id, row, col, ({_model_sql(fx.ENSEMBLE[0], {})} + {_model_sql(fx.ENSEMBLE[1], {})}) / 2 AS seg FROM bz"),
    ("bm", "SELECT image_id, row, col, greatest(0, max(seg)) AS seg, greatest(0, max(seg / 16 - 0.02::DOUBLE)) AS dens FROM bs GROUP BY ALL"),
]


@query(with_ctes(["big_px"], _REPORT.replace("FROM mosaic", "FROM bm"), extra=_BIG))
def big_tile_score(spark: SparkSession, sf: str) -> DataFrame:
    """Two models on the big rasters, windows of 128 at stride 64."""
    return report(inf.score_mosaic(fx.big_pixels(spark, sf), fx.ENSEMBLE[:2], _BIG_W, _BIG_W, _BIG_S))
