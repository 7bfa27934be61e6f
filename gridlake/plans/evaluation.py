"""Prediction against truth: segmentation scores before and after cleaning, counts, densities, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import clip_negative
from ..operators.metrics import count_errors, linregress, macro_average, segmentation_metrics
from ..operators.objects import PIXEL_AREA, count_components, count_holes, label_components, per_hectare, remove_small
from ..session import cut_lineage
from ..sources.catalog import pair_siblings


TRUTH = ("annotation", "boundary", "density")


def load_truth(catalog: DataFrame, pixels: DataFrame, layers: tuple[str, ...] = TRUTH) -> DataFrame:
    """(frame_key, row, col, layers…): the label layers of each frame, found by the names of their files.

    ``catalog`` has the paths of all files, ``pixels`` (path, row, col, value) what is in them. Files whose names differ in the layer alone are siblings;
    a frame is one whose first layer is there, and a pixel that another layer lacks, or all of a missing one, is 0.
    """
    named = pair_siblings(catalog, list(layers)).where(F.col(layers[0]).isNotNull())
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.col(name).alias("path")) for name in layers])).alias("f")
    files = named.select("frame_key", listed).select("frame_key", "f.*").where(F.col("path").isNotNull())
    rows = pixels.select("path", "row", "col", "value").join(files, "path")
    return rows.groupBy("frame_key", "row", "col").agg(
        *[F.coalesce(F.max(F.when(F.col("layer") == name, F.col("value"))), F.lit(0)).alias(name) for name in layers])


def contour_counts(df: DataFrame, value: str, keys: list[str], block: int = 64) -> DataFrame:
    """Objects plus holes per key, as a contour tree counts them; keys without any get 0."""
    objects = count_components(label_components(df.where(F.col(value) == 1), keys, 8, block), keys)
    holes = count_holes(df, value, keys, block)
    every = df.select(*keys).distinct()
    return every.join(objects, keys, "left").join(holes, keys, "left").select(
        *keys, (F.coalesce("n_objects", F.lit(0)) + F.coalesce("n_holes", F.lit(0))).alias("n_contours"))


def report_by_model(
    df: DataFrame, thres: float = 2.0, keys: list[str] | None = None, model: str = "model_id", block: int = 64,
    measure: str = "contour_area",
) -> DataFrame:
    """Macro-averaged scores per model, on the raw mask and on the mask without small objects.

    ``df`` is one row per (model, image, pixel) with truth, pred, weight, rows and cols.
    """
    image_keys = keys or [model, "image_id"]
    df = cut_lineage(df)  # read by many steps, made once
    kept, _ = remove_small(df, "pred", thres, image_keys, measure, block)
    cleaned = df.drop("pred").join(
        kept.select(*image_keys, "row", "col", F.lit(1).alias("pred")), [*image_keys, "row", "col"], "left"
    ).withColumn("pred", F.coalesce("pred", F.lit(0)))
    before = macro_average(segmentation_metrics(df, image_keys), keys=[model]).withColumn("stage", F.lit("raw"))
    after = macro_average(segmentation_metrics(cleaned, image_keys), keys=[model]).withColumn("stage", F.lit("cleaned"))
    return before.unionByName(after)


def counts_by_image(
    df: DataFrame, thres: float = 2.0, keys: list[str] | None = None, model: str = "model_id", block: int = 64, measure: str = "contour_area"
) -> DataFrame:
    """(keys, n_truth, n_before, n_after, pred_px, truth_px, n_px): contours of truth and prediction, and canopy after cleaning.

    ``df`` is as for ``report_by_model``. Images without any contour have counts of 0.
    """
    image_keys = keys or [model, "image_id"]
    df = cut_lineage(df)  # read by many steps, made once
    kept, counts = remove_small(df, "pred", thres, image_keys, measure, block)
    sums = df.groupBy(*image_keys).agg(F.sum("truth").cast("long").alias("truth_px"), F.count(F.lit(1)).alias("n_px"))
    left = kept.groupBy(*image_keys).agg(F.count(F.lit(1)).alias("pred_px"))
    truth = contour_counts(df, "truth", image_keys, block).withColumnRenamed("n_contours", "n_truth")
    joined = sums.join(counts, image_keys, "left").join(left, image_keys, "left").join(truth, image_keys)
    return joined.na.fill(0, ["n_before", "n_after", "pred_px"]).select(
        *image_keys, "n_truth", "n_before", "n_after", "pred_px", "truth_px", "n_px")


def count_report_by_model(counts: DataFrame, model: str = "model_id", px_area: float = PIXEL_AREA) -> DataFrame:
    """Totals of ``counts_by_image`` per model: counts, their decrease by cleaning, canopy against truth, objects per hectare."""
    names = ["n_truth", "n_before", "n_after", "pred_px", "truth_px", "n_px"]
    total = counts.groupBy(model).agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return total.withColumns({
        "decrease": F.try_divide(F.col("n_before") - F.col("n_after"), F.col("n_before")),
        "area_ratio": F.try_divide("pred_px", "truth_px"), "per_ha": per_hectare("n_after", "n_px", px_area)})


def count_regression_by_model(counts: DataFrame, model: str = "model_id", stage: str = "n_after") -> DataFrame:
    """Regression of the counted on the true contours of each image, per model."""
    return linregress(counts, "n_truth", stage, [model])


def report_count(pred: DataFrame, truth: DataFrame, keys: list[str] | None = None, model: str | None = None) -> DataFrame:
    """Predicted and reference totals and their density per hectare, per image (and model)."""
    keys = keys or ["image_id"]
    model_keys = [model] if model else []
    p = pred.groupBy(*model_keys, *keys).agg(F.sum(clip_negative("density")).alias("pred_count"))
    t = truth.groupBy(*keys).agg(F.sum("density").alias("truth_count"), F.count(F.lit(1)).alias("n_px"))
    both = p.join(t, keys)
    return both.withColumns({
        "area_m2": F.col("n_px") * F.lit(PIXEL_AREA),
        "pred_per_ha": per_hectare("pred_count", "n_px"), "truth_per_ha": per_hectare("truth_count", "n_px"),
    })


def count_summary(report: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(regression of predicted on reference densities, error summary)."""
    return linregress(report, "truth_per_ha", "pred_per_ha", keys), count_errors(report, "truth_per_ha", "pred_per_ha", keys)
