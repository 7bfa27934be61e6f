"""Table layouts. Every operator takes and returns plain DataFrames with these columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

PIXEL = ["image_id", "row", "col"]
WINDOW = ["image_id", "win_col", "win_row"]

IMAGES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("rows", T.IntegerType()),
    T.StructField("cols", T.IntegerType()),
])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)

POLYGONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("geom_type", T.StringType()),
    T.StructField("srid", T.IntegerType()),
    T.StructField("ring", RING),
])

CATALOG = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("modificationTime", T.TimestampType()),
])

#: fixed values: nodata markers of the written rasters
NODATA = {"mask": 255, "scaled_density": 32767, "height": 9999}

#: fixed values: band order of the source imagery
BANDS = ["red", "green", "blue", "infrared"]


def pixel_schema(bands: list[str]) -> T.StructType:
    """Long pixel table: one row per pixel, one DOUBLE column per band."""
    fields = [
        T.StructField("image_id", T.LongType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
    ]
    return T.StructType(fields + [T.StructField(b, T.DoubleType()) for b in bands])


def block_schema(bands: list[str]) -> T.StructType:
    """Block table: one row per (image, block), each band a row-major array of its pixels."""
    fields = [
        T.StructField("image_id", T.LongType()),
        T.StructField("block_row", T.IntegerType()),
        T.StructField("block_col", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
    ]
    return T.StructType(fields + [T.StructField(b, T.ArrayType(T.DoubleType())) for b in bands])


def field(name: str):
    """Lambda for the higher-order functions that takes a struct's field."""
    return lambda item: item[name]


def floor_div(value: Column, by: int) -> Column:
    """Integer floor division that stays an INT and is right for negative values."""
    return F.floor(value / F.lit(by)).cast("int")
