"""Large-scale inference: tile, normalise, score, merge, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import clip_negative, ndvi, normalize_patch, threshold, zscore
from ..operators.mosaic import CELL, apply_mosaic, mosaic, pixels_in_windows, start_value, suppress_border
from ..operators.objects import per_hectare
from ..operators.scoring import LinearModel, Scorer, ensemble_linear, score, unpatch
from ..operators.tiling import offsets_covering, pad_patch, tile_pixels
from ..schemas import PIXEL, WINDOW


def add_ndvi(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("ndvi", ndvi("infrared", "red"))


def with_gaps(merged: DataFrame, pixels: DataFrame, op: str, values: list[str], width: int, height: int, stride: int, init: float) -> DataFrame:
    """Adds the pixels that lie between windows, at the canvas's first value; there are some only if the stride is larger than a window."""
    if stride <= min(width, height):
        return merged
    gap = (F.size(offsets_covering(F.col("col"), width, stride)) == 0) | (F.size(offsets_covering(F.col("row"), height, stride)) == 0)
    empty = [F.lit(start_value(op, init)).alias(v) for v in values]
    return merged.unionByName(pixels.where(gap).select(*PIXEL, *empty))


def _bands_of(models: list[LinearModel]) -> list[str]:
    return sorted({b for m in models for b in m.bands})


def score_mosaic(
    pixels: DataFrame, models: list[LinearModel], width: int, height: int, stride: int, op: str = "MAX",
    border: int = 0, init: float = 0.0, images: DataFrame | None = None,
) -> DataFrame:
    """seg and dens per pixel for linear models, pixels shuffled once and not once per window.

    Window statistics arrive as a short list on each pixel. Scores are taken per list item in
    generated code and merged by an aggregation on (cell, pixel), whose partitioning the join
    on the cell already has. ``border`` needs the image table; the image's size travels with its windows, so
    no pixel is joined by its image. A pixel between windows keeps the canvas's first value.
    """
    bands = _bands_of(models)
    source = pixels.select(*PIXEL, *bands)
    placed = pixels_in_windows(source, bands, width, height, stride, images if border else None)
    spread = placed.withColumn("_w", F.explode("windows")).drop("windows")
    seg, dens = ensemble_linear(models, lambda b: zscore(F.col(b), F.col(f"_w.mean_{b}"), F.col(f"_w.std_{b}")))
    scored = spread.withColumns({
        "seg": seg, "dens": dens, "win_col": F.col("_w.win_col"), "win_row": F.col("_w.win_row"),
        **({"rows": F.col("_w.rows"), "cols": F.col("_w.cols")} if border else {}),
    })
    if border:
        scored = suppress_border(scored, ["seg", "dens"], border, width, height)
    merged = mosaic(scored, op, ["seg", "dens"], [*CELL, "row", "col"], init)
    return with_gaps(merged.select(*PIXEL, "seg", "dens"), pixels, op, ["seg", "dens"], width, height, stride, init)


def score_mosaic_tiled(
    pixels: DataFrame, models: list[LinearModel], width: int, height: int, stride: int, op: str = "MAX",
    border: int = 0, init: float = 0.0, images: DataFrame | None = None,
) -> DataFrame:
    """The same result spelt out with one row per (pixel, window): the form to compare with."""
    bands = _bands_of(models)
    tiles = normalize_patch(tile_pixels(pixels.select(*PIXEL, *bands), width, height, stride), WINDOW, bands)
    seg, dens = ensemble_linear(models)
    scored = tiles.select(*WINDOW, "row", "col", seg.alias("seg"), dens.alias("dens"))
    merged = apply_mosaic(scored, op, ["seg", "dens"], width, height, border, images, init=init)
    return with_gaps(merged, pixels, op, ["seg", "dens"], width, height, stride, init)


def score_mosaic_model(
    pixels: DataFrame, images: DataFrame, load_scorer: Callable[[], Scorer], bands: list[str], width: int,
    height: int, stride: int, op: str = "MAX", border: int = 0, normalize: bool = True, batch_rows: int | None = None,
    init: float = 0.0,
) -> DataFrame:
    """seg and dens per pixel for any Python model: padded patches go to it in Arrow batches.

    Window statistics come from the cells, as in ``score_mosaic``, so the copies of a pixel are
    made once, on the way into the patches.
    """
    if normalize:
        placed = pixels_in_windows(pixels.select(*PIXEL, *bands), bands, width, height, stride)
        tiles = placed.withColumn("_w", F.explode("windows")).select(
            "image_id", "row", "col", "_w.win_col", "_w.win_row",
            *[zscore(F.col(b), F.col(f"_w.mean_{b}"), F.col(f"_w.std_{b}")).alias(b) for b in bands])
    else:
        tiles = tile_pixels(pixels.select(*PIXEL, *bands), width, height, stride)
    scored = score(pad_patch(tiles, bands, width, height), load_scorer, bands, width, height, batch_rows=batch_rows)
    merged = apply_mosaic(unpatch(scored, width, images=images), op, ["seg", "dens"], width, height, border, images, init=init)
    return with_gaps(merged, pixels, op, ["seg", "dens"], width, height, stride, init)


def detect(mosaicked: DataFrame, th: float = 0.5) -> DataFrame:
    """Mask and density of a merged raster."""
    return mosaicked.select(*PIXEL, threshold("seg", th).alias("mask"), F.col("dens").alias("density"))


def image_report(detected: DataFrame, px_area: float) -> DataFrame:
    """Per image: object pixels, density count, pixels, objects per hectare."""
    sums = detected.groupBy("image_id").agg(
        F.sum("mask").alias("mask_px"), F.sum(clip_negative("density")).alias("n_objects"),
        F.count(F.lit(1)).alias("n_px"))
    return sums.withColumn("per_ha", per_hectare("n_objects", "n_px", px_area))
