"""Windows, patches and batches.

A window is addressed by its offset (win_col, win_row). The order of windows is the
column-major one, i.e. that of the struct (win_col, win_row), so it needs no image size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import hash_index
from ..functions.numbering import ordered_number
from ..schemas import WINDOW, field, floor_div


def offsets_covering(position: Column, width: int, stride: int) -> Column:
    """Offsets k·stride ≥ 0 of the windows that cover a position, as an array (empty in gaps)."""
    first = F.greatest(F.lit(0), floor_div(position - F.lit(width), stride) + 1) * F.lit(stride)
    last = floor_div(position, stride) * F.lit(stride)
    return F.when(first <= last, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def window_grid(images: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """All windows of each image, clipped to it, with their ordinal ``seq``; offsets run past the last full window."""
    down = F.ceil(F.col("rows") / F.lit(stride)).cast("long")
    return (
        images.withColumn("win_col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1, F.lit(stride))))
        .withColumn("win_row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(stride))))
        .select(
            "image_id", "win_col", "win_row",
            F.least(F.lit(width), F.col("cols") - F.col("win_col")).alias("w"),
            F.least(F.lit(height), F.col("rows") - F.col("win_row")).alias("h"),
            (floor_div(F.col("win_col"), stride) * down + floor_div(F.col("win_row"), stride)).alias("seq"),
        )
    )


def tile_pixels(pixels: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """Copies each pixel into every window that covers it: arithmetic and explode, no join."""
    return pixels.withColumn("win_col", F.explode(offsets_covering(F.col("col"), width, stride))).withColumn(
        "win_row", F.explode(offsets_covering(F.col("row"), height, stride))
    )


def to_blocks(pixels: DataFrame, bands: list[str], size: int) -> DataFrame:
    """Storage layout: one row per block with row-major band arrays; at most size² pixels per group."""
    keyed = pixels.withColumns({
        "block_row": floor_div(F.col("row"), size), "block_col": floor_div(F.col("col"), size),
    })
    cell = F.struct("row", "col", *bands)
    blocks = keyed.groupBy("image_id", "block_row", "block_col").agg(F.sort_array(F.collect_list(cell)).alias("px"))
    return blocks.select(
        "image_id", "block_row", "block_col",
        F.transform("px", lambda p: p["row"]).alias("rows"), F.transform("px", lambda p: p["col"]).alias("cols"),
        *[F.transform("px", field(b)).alias(b) for b in bands],
    )


def from_blocks(blocks: DataFrame, bands: list[str]) -> DataFrame:
    names = ["rows", "cols", *bands]
    return blocks.select("image_id", F.explode(F.arrays_zip(*names)).alias("p")).select(
        "image_id", F.col("p.rows").alias("row"), F.col("p.cols").alias("col"), *[F.col(f"p.{b}").alias(b) for b in bands]
    )


def read_window(blocks: DataFrame, windows: DataFrame, bands: list[str], size: int) -> DataFrame:
    """Only the pixels of the asked windows: equi join on the block indexes they touch, then cut to the window."""
    touched = (
        windows.withColumn("block_row", F.explode(F.sequence(
            floor_div(F.col("win_row"), size), floor_div(F.col("win_row") + F.col("h") - 1, size))))
        .withColumn("block_col", F.explode(F.sequence(
            floor_div(F.col("win_col"), size), floor_div(F.col("win_col") + F.col("w") - 1, size))))
    )
    joined = blocks.join(touched, ["image_id", "block_row", "block_col"])
    names = ["rows", "cols", *bands]
    px = joined.select("image_id", "win_col", "win_row", "w", "h", F.explode(F.arrays_zip(*names)).alias("p"))
    px = px.select(
        "image_id", "win_col", "win_row", "w", "h",
        F.col("p.rows").alias("row"), F.col("p.cols").alias("col"), *[F.col(f"p.{b}").alias(b) for b in bands],
    )
    inside = (
        (F.col("row") >= F.col("win_row")) & (F.col("row") < F.col("win_row") + F.col("h"))
        & (F.col("col") >= F.col("win_col")) & (F.col("col") < F.col("win_col") + F.col("w"))
    )
    return px.where(inside).drop("w", "h")


def read_box(blocks: DataFrame, bands: list[str], size: int, row: int, col: int, height: int, width: int) -> DataFrame:
    """One literal window: the block range is a plain filter and is pushed to the Parquet scan."""
    wanted = blocks.where(
        F.col("block_row").between(row // size, (row + height - 1) // size)
        & F.col("block_col").between(col // size, (col + width - 1) // size)
    )
    px = from_blocks(wanted, bands)
    return px.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def pad_patch(tiled: DataFrame, bands: list[str], width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """One row per window with zero-filled row-major arrays of width·height values per band.

    Each group holds at most width·height pixels. Zeros are mixed in under every position and
    lose against the pixel of the same position after sorting.
    """
    keys = keys or WINDOW
    position = ((F.col("row") - F.col("win_row")) * F.lit(width) + (F.col("col") - F.col("win_col"))).cast("int")
    entry = F.struct(position.alias("pos"), F.lit(1).alias("real"), *[F.col(b).cast("double").alias(b) for b in bands])
    zero = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.struct(
        i.cast("int").alias("pos"), F.lit(0).alias("real"), *[F.lit(0.0).alias(b) for b in bands]))
    grouped = tiled.select(*keys, entry.alias("e")).groupBy(*keys).agg(F.collect_list("e").alias("px"))
    merged = grouped.select(*keys, F.array_sort(F.concat("px", zero)).alias("px"))
    kept = merged.select(*keys, F.filter("px", lambda x, i: (
        F.get(F.col("px"), i + 1)["pos"].isNull() | (F.get(F.col("px"), i + 1)["pos"] != x["pos"])
    )).alias("px"))
    return kept.select(*keys, *[F.transform("px", field(b)).alias(b) for b in bands])


# --- patches of frames ------------------------------------------------------------------------


def _starts(extent: Column, size: int, step: int) -> Column:
    """Exclusive end: the last full patch is dropped; a frame no larger than the patch has one start."""
    small = extent <= F.lit(size)
    return F.when(small, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.greatest(extent - F.lit(size + 1), F.lit(0)), F.lit(step))
    )


def sequential_patches(frames: DataFrame, size: int, step: int) -> DataFrame:
    """Regular patch origins (patch_row, patch_col) of each frame(frame_id, rows, cols)."""
    return (
        frames.withColumn("patch_row", F.explode(_starts(F.col("rows"), size, step)))
        .withColumn("patch_col", F.explode(_starts(F.col("cols"), size, step)))
    )


def random_patches(frames: DataFrame, n: int, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """``n`` hashed origins per frame, uniform in [0, extent - size), 0 in small frames."""
    slots = frames.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ids = [F.lit(epoch), F.col("frame_id"), F.col("slot")]
    return slots.withColumns({
        "patch_row": hash_index(F.col("rows") - F.lit(size), f"{seed}r", *ids),
        "patch_col": hash_index(F.col("cols") - F.lit(size), f"{seed}c", *ids),
    })


def sample_frames(frames: DataFrame, steps: int, batch: int, seed: int, epoch: int = 0) -> DataFrame:
    """One row per batch slot with a frame drawn with replacement.

    Frames are numbered in the order of their id, whatever the ids are, so no slot stays empty while there is a frame.
    """
    spark = frames.sparkSession
    numbered = ordered_number(frames, ["frame_id"], "frame_idx")
    n_frames = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    slots = spark.range(steps * batch).select(
        F.floor(F.col("id") / F.lit(batch)).cast("int").alias("step"), F.pmod("id", F.lit(batch)).cast("int").alias("slot")
    )
    drawn = slots.withColumn(
        "frame_idx", hash_index(n_frames, f"{seed}f", F.lit(epoch), F.col("step"), F.col("slot")).cast("long")
    )
    return drawn.join(numbered, "frame_idx")


def cut_patches(pixels: DataFrame, patches: DataFrame, size: int, frame: str = "frame_id") -> DataFrame:
    """Pixels of each patch. Joined on size×size cells, of which a patch touches at most four."""
    cells = (
        patches.withColumn("_pr", F.explode(F.sequence(
            floor_div(F.col("patch_row"), size), floor_div(F.col("patch_row") + size - 1, size))))
        .withColumn("_pc", F.explode(F.sequence(
            floor_div(F.col("patch_col"), size), floor_div(F.col("patch_col") + size - 1, size))))
    )
    px = pixels.withColumns({"_pr": floor_div(F.col("row"), size), "_pc": floor_div(F.col("col"), size)})
    joined = px.join(cells, [frame, "_pr", "_pc"]).drop("_pr", "_pc")
    r, c = F.col("row") - F.col("patch_row"), F.col("col") - F.col("patch_col")
    return joined.where(r.between(0, size - 1) & c.between(0, size - 1)).withColumns({"row": r, "col": c})


def zero_pad(cut: DataFrame, patches: DataFrame, size: int, keys: list[str], values: list[str]) -> DataFrame:
    """Adds zero rows where a patch reaches beyond its frame: ``patches`` has keys, patch_row, patch_col, rows, cols.

    Only patches of frames smaller than the patch do; the rows come from arithmetic, not from a join with the pixels.
    """
    high, wide = F.col("rows") - F.col("patch_row"), F.col("cols") - F.col("patch_col")
    beyond = patches.where((high < size) | (wide < size)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    beyond = beyond.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).where((F.col("row") >= high) | (F.col("col") >= wide))
    return cut.unionByName(beyond.select(*keys, "row", "col", *[F.lit(0.0).alias(v) for v in values]))


def half_res_pair(pixels: DataFrame, half: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds the columns of a half-resolution table: same key, row and column halved."""
    keys = keys or ["image_id"]
    left = pixels.withColumns({"_hr": floor_div(F.col("row"), 2), "_hc": floor_div(F.col("col"), 2)})
    right = half.withColumnsRenamed({"row": "_hr", "col": "_hc"})
    return left.join(right, [*keys, "_hr", "_hc"]).drop("_hr", "_hc")


def select_bands(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Keeps and orders bands; the pruning reaches the Parquet scan."""
    return df.select(*(keys or ["image_id", "row", "col"]), *bands)


def assign_batches(windows: DataFrame, size: int) -> DataFrame:
    """Scoring batch and slot of each window by its ordinal; the last batch of an image may be short."""
    return windows.withColumns({
        "batch": F.floor(F.col("seq") / F.lit(size)).cast("long"), "slot": F.pmod("seq", F.lit(size)).cast("int"),
    })


def patch_stats(df: DataFrame, keys: list[str], bands: list[str], density: str | None = None) -> DataFrame:
    """Mean, population deviation, maximum and value range per band, and the density sum, per patch."""
    aggs = [F.count(F.lit(1)).alias("n_px")]
    for b in bands:
        aggs += [
            F.avg(b).alias(f"{b}_mean"), F.stddev_pop(b).alias(f"{b}_std"),
            F.max(b).alias(f"{b}_max"), (F.max(b) - F.min(b)).alias(f"{b}_range"),
        ]
    if density:
        aggs.append(F.sum(density).alias("object_count"))
    return df.groupBy(*keys).agg(*aggs)


def distinct_weights(df: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """The weights of each batch and on how many pixels each stands: one row a weight, so that a long tail of weights is no long row."""
    return df.groupBy(*keys, weight).agg(F.count(F.lit(1)).alias("n_px"))
