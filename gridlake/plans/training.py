"""Training batches as one deterministic table per epoch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.bands import maybe_normalize
from ..functions.draws import hash_index
from ..operators.labels import binarize, boundary_weight
from ..operators.patches import THERE, Known, bilinear, crop_positions, to_patches, transformed
from ..operators.sampling import chances, crop_margins, flip_lr, flip_ud, random_crop_resize
from ..operators.tiling import cut_patches, distinct_weights, patch_stats, sample_frames, zero_pad

PATCH = ["step", "slot"]


def epoch_steps(n_frames: int, batch: int, per_frame: int) -> int:
    """Steps of an epoch that draws so many patches a frame on average; one at least."""
    return max(1, -(-n_frames * per_frame // batch))


def draw_patches(frames: DataFrame, epoch: int, steps: int, batch: int, size: int, seed: int) -> DataFrame:
    """(step, slot, frame_id, rows, cols, patch_row, patch_col) of one epoch; frames is (frame_id, rows, cols)."""
    drawn = sample_frames(frames, steps, batch, seed, epoch)
    ids = [F.lit(epoch), F.col("step"), F.col("slot")]
    return drawn.select(
        "step", "slot", "frame_id", "rows", "cols",
        hash_index(F.col("rows") - F.lit(size), f"{seed}r", *ids).alias("patch_row"),
        hash_index(F.col("cols") - F.lit(size), f"{seed}c", *ids).alias("patch_col"))


def training_batches(
    frames: DataFrame, pixels: DataFrame, epoch: int, steps: int, batch: int, size: int, bands: list[str],
    seed: int = 1117, normalize: float = 0.4, weight: float = 5.0, augment: bool = True,
) -> DataFrame:
    """Rows (step, slot, row, col, bands…, ann, weight, density) of one epoch.

    ``pixels`` is (frame_id, row, col, bands…, annotation, boundary, density). The same seed,
    epoch and step always give the same rows, whatever the partitioning. Frames smaller than the patch are
    normalised by their own pixels, then padded with zeros (weight 1).
    """
    patches = draw_patches(frames, epoch, steps, batch, size, seed)
    labels = ["annotation", "boundary", "density"]
    cut = cut_patches(pixels.select("frame_id", "row", "col", *bands, *labels), patches.drop("rows", "cols"), size)
    px = cut.select(*PATCH, "row", "col", *[F.col(c).cast("double").alias(c) for c in [*bands, *labels]])
    tag = f"{seed}-{epoch}-"
    px = maybe_normalize(px, normalize, f"{tag}n", PATCH, bands).select(*PATCH, "row", "col", *bands, *labels)
    px = zero_pad(px, patches, size, PATCH, [*bands, *labels])
    if augment:
        px = flip_ud(flip_lr(px, size, f"{tag}a", PATCH), size, f"{tag}a", PATCH)
        px = random_crop_resize(px, size, f"{tag}a", PATCH, [*bands, *labels], grow=True)
    return px.select(
        *PATCH, "row", "col", *bands, binarize("annotation").alias("ann"),
        boundary_weight("boundary", weight).alias("weight"), "density")


def two_resolution_batches(
    frames: DataFrame, pixels: DataFrame, half: DataFrame, epoch: int, steps: int, batch: int, size: int, bands: list[str], half_bands: list[str],
    seed: int = 1117, normalize: float = 0.4, weight: float = 5.0, augment: bool = True,
) -> DataFrame:
    """(step, slot, there, bands…, half_bands…, ann, weight, density): row-major arrays, size² values, those of ``half_bands`` (size / 2)².

    ``there`` says at which places of the patch its frame has a pixel, or one was read; values are null elsewhere.
    ``pixels`` is as for ``training_batches``, ``half`` (frame_id, row, col, half_bands…) the same frames at half the resolution, cut at half the
    patch's origin. What is drawn for a patch, its normalisation, flips and margins, holds for all its arrays, each in its own pixels. Patches stay arrays
    from the cut on: a shuffle for each resolution, one join of a row a patch, one Arrow pass.
    """
    if size % 2:
        raise ValueError("patches of two resolutions need an even size")
    patches = draw_patches(frames, epoch, steps, batch, size, seed)
    tag, labels, small = f"{seed}-{epoch}-", ["annotation", "boundary", "density"], size // 2
    halved = patches.withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in ("rows", "cols", "patch_row", "patch_col")})

    def gathered(table: DataFrame, origin: DataFrame, side: int, inputs: list[str], others: list[str], there: str) -> DataFrame:
        names = [*inputs, *others]
        cut = cut_patches(table.select("frame_id", "row", "col", *names), origin.drop("rows", "cols"), side)
        px = cut.select(*PATCH, "row", "col", *[F.col(c).cast("double").alias(c) for c in names])
        px = maybe_normalize(px, normalize, f"{tag}n", PATCH, inputs).select(*PATCH, "row", "col", *names)
        return to_patches(zero_pad(px, origin, side, PATCH, names), side, PATCH, names, there)

    both = gathered(pixels, patches, size, bands, labels, THERE).join(gathered(half, halved, small, half_bands, [], "_half"), PATCH)
    sizes = dict.fromkeys([*bands, *labels], size) | dict.fromkeys(half_bands, small)
    draws = chances(f"{tag}a", PATCH, lr=0.5, ud=0.5, crop=0.5) | crop_margins(size, f"{tag}a", PATCH) if augment else {}

    def work(arrays: dict[str, Known], drawn: dict[str, np.ndarray]) -> dict[str, Known]:
        if not augment:
            return arrays
        lr, ud, crop = (drawn[n].astype(bool)[:, None, None] for n in ("lr", "ud", "crop"))
        out = {}
        for n, known in arrays.items():
            x = [np.where(lr, v[:, :, ::-1], v) for v in known]
            x = [np.where(ud, v[:, ::-1, :], v) for v in x]
            read = bilinear(*x, *crop_positions(x[0].shape[1], drawn, size / x[0].shape[1]))
            out[n] = tuple(np.where(crop, r, v) for r, v in zip(read, x, strict=True))
        return out

    both = transformed(both, PATCH, draws, work, sizes, dict.fromkeys(half_bands, "_half"))
    weights = F.zip_with(THERE, "boundary", lambda there, v: F.when(there, boundary_weight(v, weight)))
    return both.select(*PATCH, THERE, *bands, *half_bands, F.transform("annotation", binarize).alias("ann"), weights.alias("weight"), "density")


def batch_report(batches: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """What one looks at before a training run: (statistics of each patch with its object count, the loss weights of each step)."""
    return patch_stats(batches, PATCH, bands, "density"), distinct_weights(batches, ["step"])


def write_epoch(batches: DataFrame, path: str, epoch: int) -> None:
    """One folder per epoch and step."""
    batches.repartition("step").write.mode("errorifexists").partitionBy("step").parquet(f"{path}/epoch={epoch}")
