"""Merging overlapping window results back into one raster.

MAX, MIN and REPLACE are algebraic and combine before the shuffle. MIX is an ordered fold;
a pixel has at most ⌈width/stride⌉² values, so its list is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import NAN
from ..schemas import PIXEL, WINDOW, field, floor_div
from .tiling import offsets_covering

CELL = ["image_id", "cell_col", "cell_row"]
OPERATORS = ("MAX", "MIN", "REPLACE", "MIX")


def window_order() -> Column:
    """(win_col, win_row) in one BIGINT, so that the aggregates that order by it can be hashed."""
    return F.shiftleft(F.col("win_col").cast("long"), 32).bitwiseOR(F.col("win_row").cast("long"))


def mix_fold(values: Column, start: float = 0.0) -> Column:
    """acc → (acc + v) / 2 unless acc is 0 (empty); where that leaves 0, v itself."""
    def step(acc: Column, v: Column) -> Column:
        blended = F.when(acc != 0, acc * 0.5 + v * 0.5).otherwise(acc)
        return F.when(blended == 0, v).otherwise(blended)

    return F.aggregate(values, F.lit(float(start)), step)


def start_value(op: str, init: float) -> float:
    """The accumulator's first value; -1 means unset for MIN and counts as 1."""
    return 1.0 if op == "MIN" and init == -1 else float(init)


def merge_expression(op: str, value: str, order: Column, init: float = 0.0) -> Column:
    """The aggregate that merges the window values of one pixel."""
    v = F.col(value).cast("double")
    first = F.lit(start_value(op, init))
    if op == "MAX":
        return F.greatest(first, F.max(v))
    if op == "MIN":
        return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(F.least(first, F.min(v)))
    if op == "REPLACE":
        return F.max_by(v, order)
    if op == "MIX":
        ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v"))))
        return mix_fold(F.transform(ordered, lambda s: s["v"]), init)
    raise ValueError(f"unknown merge operator {op!r}; use one of {OPERATORS}")


def suppress_border(
    df: DataFrame, values: list[str], n: int, width: int, height: int, images: DataFrame | None = None
) -> DataFrame:
    """Zeroes the n-pixel rim of every clipped window. Needs ``rows``/``cols`` columns or the image table."""
    if images is not None:
        df = df.join(images.select("image_id", "rows", "cols"), "image_id")
    w = F.least(F.lit(width), F.col("cols") - F.col("win_col"))
    h = F.least(F.lit(height), F.col("rows") - F.col("win_row"))
    r, c = F.col("row") - F.col("win_row"), F.col("col") - F.col("win_col")
    rim = (r < n) | (c < n) | (r >= h - n) | (c >= w - n)
    out = df.withColumns({v: F.when(rim, F.lit(0.0)).otherwise(F.col(v)) for v in values})
    return out.drop("rows", "cols") if images is not None else out


def mosaic(
    df: DataFrame, op: str, values: list[str], keys: list[str] | None = None, init: float = 0.0
) -> DataFrame:
    """Merges the rows of each pixel by MAX, MIN, REPLACE or MIX."""
    keys = keys or PIXEL
    return df.groupBy(*keys).agg(*[merge_expression(op, v, window_order(), init).alias(v) for v in values])


def apply_mosaic(
    df: DataFrame, op: str, values: list[str], width: int, height: int, border: int = 0,
    images: DataFrame | None = None, keys: list[str] | None = None, init: float = 0.0,
) -> DataFrame:
    """Border suppression where asked, then the merge, for all heads at once."""
    if border:
        df = suppress_border(df, values, border, width, height, images)
    return mosaic(df, op, values, keys, init)


# --- merge without copying pixels ----------------------------------------------------------------
#
# Lines at multiples of the stride and at multiples + width cut an image into cells whose pixels
# all lie in exactly the same windows. Window statistics can therefore be built from per-cell
# statistics, and be handed back per cell: pixels are shuffled once, not once per window.


def cell_index(position: Column, width: int, stride: int) -> Column:
    """Number of the cell along one axis."""
    rest = width % stride
    whole = floor_div(position, stride)
    if rest == 0:
        return whole
    return whole * 2 + F.when(F.pmod(position, F.lit(stride)) >= rest, F.lit(1)).otherwise(F.lit(0))


def _cell_origin(cell: Column, width: int, stride: int) -> Column:
    rest = width % stride
    if rest == 0:
        return cell * F.lit(stride)
    return floor_div(cell, 2) * F.lit(stride) + F.pmod(cell, F.lit(2)) * F.lit(rest)


def with_cells(pixels: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    return pixels.withColumns({
        "cell_col": cell_index(F.col("col"), width, stride), "cell_row": cell_index(F.col("row"), height, stride),
    })


def cells_to_windows(cells: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """Copies each cell row into the windows that contain the cell."""
    col0 = _cell_origin(F.col("cell_col"), width, stride)
    row0 = _cell_origin(F.col("cell_row"), height, stride)
    return cells.withColumn("win_col", F.explode(offsets_covering(col0, width, stride))).withColumn(
        "win_row", F.explode(offsets_covering(row0, height, stride))
    )


def cell_moments(pixels: DataFrame, bands: list[str], width: int, height: int, stride: int) -> DataFrame:
    """Count, mean and population variance of each band per cell."""
    return _moments(with_cells(pixels, width, height, stride), bands, F.lit(1))


def _moments(placed: DataFrame, bands: list[str], *counted: Column | str) -> DataFrame:
    aggs = [F.call_function("count", *[F.col(c) if isinstance(c, str) else c for c in counted]).cast("double").alias("n")]
    for b in bands:
        aggs += [F.avg(b).alias(f"m_{b}"), F.var_pop(b).alias(f"v_{b}")]
    return placed.groupBy(*CELL).agg(*aggs)


def window_moments(cells: DataFrame, bands: list[str], width: int, height: int, stride: int) -> DataFrame:
    """Mean and population deviation per window, merged from its cells.

    A window has at most (2·⌈width/stride⌉)² cells, so the list is short and the merge
    uses deviations from the window mean, not differences of large sums.
    """
    part = F.struct("n", *[F.col(f"m_{b}") for b in bands], *[F.col(f"v_{b}") for b in bands])
    wins = cells_to_windows(cells, width, height, stride).groupBy(*WINDOW).agg(
        F.collect_list(part).alias("parts"), F.sum("n").alias("n")
    )

    def total(term) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["n"] * term(p)) / F.col("n")

    def spread(b: str):
        def term(p: Column) -> Column:
            away = p[f"m_{b}"] - F.col(f"mean_{b}")
            return p[f"v_{b}"] + away * away

        return term

    wins = wins.withColumns({f"mean_{b}": total(field(f"m_{b}")) for b in bands})
    return wins.select(
        "image_id", "win_col", "win_row", *[f"mean_{b}" for b in bands],
        *[F.sqrt(total(spread(b))).alias(f"std_{b}") for b in bands],
    )


def windows_per_cell(windows: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """One row per cell with the ordered list of its windows and their statistics, at most ⌈width/stride⌉² long.

    The cells of a window follow from its offset. Some lie beyond the image; no pixel asks for them.
    """
    def cells(offset: str, size: int) -> Column:
        at = F.col(offset)
        return F.explode(F.sequence(cell_index(at, size, stride), cell_index(at + F.lit(size - 1), size, stride)))

    stats = [c for c in windows.columns if c not in WINDOW]
    laid = windows.withColumn("cell_col", cells("win_col", width)).withColumn("cell_row", cells("win_row", height))
    return laid.groupBy(*CELL).agg(
        F.array_sort(F.collect_list(F.struct("win_col", "win_row", *stats))).alias("windows"))


def pixels_in_windows(
    pixels: DataFrame, bands: list[str], width: int, height: int, stride: int, images: DataFrame | None = None
) -> DataFrame:
    """Pixels with ``windows``: for each covering window, in order, its offset and band statistics, and with ``images`` the image's size.

    Two small aggregations and one shuffle of the pixels on (image, cell); none is copied. The statistics are taken from that shuffle, so the
    pixels are made once.
    """
    placed = with_cells(pixels.select("image_id", "row", "col", *bands), width, height, stride)
    placed = placed.where(" AND ".join(f"{c} IS NOT NULL" for c in CELL)).repartition(*CELL)
    # the same filter, and the same columns by counting rows and columns, which no pixel of a cell lacks: so Spark shuffles once for both branches
    cells = _moments(placed, bands, "row", "col")
    wins = window_moments(cells, bands, width, height, stride)
    if images is not None:
        wins = wins.join(images.select("image_id", "rows", "cols"), "image_id")
    per_cell = windows_per_cell(wins, width, height, stride)
    # one row a cell is hashed and the pixels are not sorted
    return placed.join(per_cell.hint("shuffle_hash"), CELL)
