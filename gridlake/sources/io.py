"""Readers and sinks for polygon, frame, mask and label tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bands import cast_dtype, height_scale, threshold
from ..functions.numbering import ordered_number
from ..operators.spatial_join import check_crs
from ..schemas import NODATA


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Crown polygons: id, geom_type, srid, ring."""
    return spark.read.parquet(path).select("id", "geom_type", "srid", "ring")


def number_areas(areas: DataFrame, order: str = "area_key") -> DataFrame:
    """Areas numbered 0..n-1 in the order of their key."""
    return ordered_number(areas, [order], "id")


def read_areas(spark: SparkSession, path: str, order: str = "area_key") -> DataFrame:
    return number_areas(spark.read.parquet(path), order)


def require_same_crs(polygons: DataFrame, areas: DataFrame) -> None:
    odd = check_crs(polygons, areas).limit(5).collect()
    if odd:
        raise ValueError(f"layers differ in reference system: {[r['srid'] for r in odd]}")


def read_frames(layers: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Aligned layers (image, annotation, boundary, density …) as one row per frame pixel.

    The first layer leads; where a sparse label layer has no row, its values are 0. Union and
    aggregate, so all layers meet in one shuffle.
    """
    keys = keys or ["frame_id", "row", "col"]
    names = list(layers)
    values = {n: [c for c in layers[n].columns if c not in keys] for n in names}
    tagged = [layers[n].withColumn("_lead", F.lit(int(n == names[0]))) for n in names]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rows = merged.groupBy(*keys).agg(
        F.max("_lead").alias("_lead"), *[F.max(v).alias(v) for n in names for v in values[n]])
    zero_filled = {v: F.coalesce(F.col(v), F.lit(0)) for n in names[1:] for v in values[n]}
    return rows.where(F.col("_lead") == 1).drop("_lead").withColumns(zero_filled)


def stack_bands(parts: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Bands of several tables side by side, in table order; pixels must be in all of them."""
    keys = keys or ["image_id", "row", "col"]
    return reduce(lambda a, b: a.join(b, keys), parts)


def mask_table(
    df: DataFrame, value: str, dtype: str = "uint8", th: float | None = 0.5, scale: str | None = None
) -> DataFrame:
    """``value`` as it is written: threshold (float to integer only), or fixed-point scale, then cast."""
    x = F.col(value)
    if scale:
        x = height_scale(x, scale)
    elif th is not None and "int" in dtype:
        x = threshold(x, th)
    return df.withColumn(value, cast_dtype(x, dtype))


def nodata_for(kind: str) -> int:
    return NODATA[kind]


def with_nodata(df: DataFrame, value: str, nodata: int) -> DataFrame:
    """Marks the nodata value in the column's metadata; on read it becomes NULL."""
    return df.withColumn(value, F.col(value).alias(value, metadata={"nodata": nodata}))


def nodata_to_null(value: Column | str, nodata: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value != F.lit(nodata), value)


def write_mask(
    df: DataFrame, path: str, value: str, dtype: str = "uint8", nodata: int = 255, th: float | None = 0.5,
    scale: str | None = None, block: int = 512,
) -> None:
    """One folder per image, so that finished images are pruned and skipped by partition.

    Rows are spread over (image, block) and not over the image alone: a large image is
    written by many tasks. The folders of the images in ``df`` are replaced, others stay, so a
    repeated job leaves what one run leaves.
    """
    out = with_nodata(mask_table(df, value, dtype, th, scale), value, nodata)
    spread = F.floor(F.col("row") / F.lit(block)), F.floor(F.col("col") / F.lit(block))
    writer = out.repartition("image_id", *spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("image_id").parquet(path)


def annotation_json(polygons: DataFrame, frame: str = "frame_id", ring: str = "pixels") -> DataFrame:
    """(frame, value): one JSON document {"Trees": [[[row, col], …], …]} per frame, in polygon order."""
    points = F.transform(ring, lambda p: F.array(p["row"], p["col"]))
    trees = F.transform(F.array_sort(F.collect_list(F.struct("id", points.alias("p")))), lambda s: s["p"])
    return polygons.groupBy(frame).agg(F.to_json(F.struct(trees.alias("Trees"))).alias("value"))


def write_annotation_json(polygons: DataFrame, path: str, frame: str = "frame_id", ring: str = "pixels") -> None:
    annotation_json(polygons, frame, ring).write.mode("errorifexists").partitionBy(frame).text(path)


def frame_counts(frames: DataFrame, polygons: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Polygon count per extracted frame, 0 for empty ones."""
    counts = polygons.groupBy(frame).agg(F.count(F.lit(1)).alias("n"))
    return frames.select(frame).join(counts, frame, "left").select(frame, F.coalesce("n", F.lit(0)).alias("n"))


def write_frame_counts(frames: DataFrame, polygons: DataFrame, path: str, frame: str = "frame_id") -> None:
    frame_counts(frames, polygons, frame).write.mode("errorifexists").parquet(path)
