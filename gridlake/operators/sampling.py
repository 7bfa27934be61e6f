"""Splits, over-sampling and reproducible augmentation of training patches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import hash01, hash_range
from ..functions.numbering import hashed_rank
from .patches import Positions, affine_positions, crop_positions, resampled
from .resample import convolve_separable, gaussian_weights


def kfold(frames: DataFrame, n: int = 10, seed: int = 1117, key: str = "frame_id") -> DataFrame:
    """(key, fold): folds of a hashed order, sizes differing by at most one, the larger ones first."""
    ranked = hashed_rank(frames.select(key), seed, [key])
    size, more = F.floor(F.col("total") / F.lit(n)), F.pmod("total", F.lit(n))
    at = F.col("rank") - 1
    in_larger = at < more * (size + 1)
    fold = F.when(in_larger, F.floor(at / (size + 1))).otherwise(
        more + F.floor(F.try_divide(at - more * (size + 1), size)))
    return ranked.select(key, fold.cast("int").alias("fold"))


def kfold_roles(folds: DataFrame, n: int = 10, key: str = "frame_id") -> DataFrame:
    """(split, key, role): in split i, fold i is the test set and the others train."""
    splits = folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("fold") == F.col("split"), F.lit("test")).otherwise(F.lit("train"))
    return splits.select("split", key, role.alias("role"))


def train_val_split(frames: DataFrame, val: float = 0.2, seed: int = 1117, key: str = "frame_id") -> DataFrame:
    """(key, role): the first ⌈n·val⌉ frames of a hashed order validate."""
    ranked = hashed_rank(frames.select(key), seed, [key])
    n_val = F.ceil(F.col("total") * F.lit(float(val)) - F.lit(1e-9))
    return ranked.select(key, F.when(F.col("rank") <= n_val, F.lit("val")).otherwise(F.lit("train")).alias("role"))


def oversample(local: DataFrame, times: int) -> DataFrame:
    """Repeats the local set; ``copy`` tells the repeats apart."""
    return local.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def union_sources(local: DataFrame, base: DataFrame) -> DataFrame:
    """Pretraining frames appended to local ones; columns only one side has are NULL on the other."""
    return local.withColumn("origin", F.lit("local")).unionByName(
        base.withColumn("origin", F.lit("base")), allowMissingColumns=True)


# --- augmentation: one decision per patch, the same for inputs and labels ------------------------------


def _ids(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _chance(p: float, seed: str, keys: list[str]) -> Column:
    return hash01(seed, *_ids(keys)) < F.lit(float(p))


def chances(seed: int | str, keys: list[str], **shares: float) -> dict[str, Column]:
    """One yes or no a patch for each name."""
    return {name: _chance(p, f"{seed}{name}", keys) for name, p in shares.items()}


def flip_lr(df: DataFrame, size: int, seed: int, keys: list[str], p: float = 0.5) -> DataFrame:
    turned = F.when(_chance(p, f"{seed}lr", keys), F.lit(size - 1) - F.col("col")).otherwise(F.col("col"))
    return df.withColumn("col", turned)


def flip_ud(df: DataFrame, size: int, seed: int, keys: list[str], p: float = 0.5) -> DataFrame:
    turned = F.when(_chance(p, f"{seed}ud", keys), F.lit(size - 1) - F.col("row")).otherwise(F.col("row"))
    return df.withColumn("row", turned)


def _resampled(
    df: DataFrame, size: int, keys: list[str], values: list[str], draws: dict[str, Column], positions: Positions, chosen: Column, grow: bool = False
) -> DataFrame:
    """Bilinear read of the chosen patches at mapped positions; the others pass through."""
    moved = resampled(df.where(chosen), size, keys, values, draws, positions, grow)
    return df.where(~chosen).select(*keys, "row", "col", *values).unionByName(moved)


def crop_margins(size: int, seed: int | str, keys: list[str], share: float = 0.1) -> dict[str, Column]:
    """Pixels to cut off each side, 0 to ``share`` of the patch."""
    return {side: F.floor(hash_range(0.0, share * size, f"{seed}{side}", *_ids(keys))) for side in ("top", "bottom", "left", "right")}


def random_crop_resize(
    df: DataFrame, size: int, seed: int, keys: list[str], values: list[str], share: float = 0.1, p: float = 0.5, grow: bool = False
) -> DataFrame:
    """Cuts 0–10 % off each side and stretches the rest back to the patch size. Patches are square.

    Pixels that a patch lacks add nothing. It keeps the places of its pixels; with ``grow`` it gets all places at which one of them is read.
    """
    return _resampled(df, size, keys, values, crop_margins(size, seed, keys, share), crop_positions, _chance(p, f"{seed}crop", keys), grow)


def affine(
    df: DataFrame, size: int, seed: int, keys: list[str], values: list[str], p: float = 0.5,
    scale: tuple[float, float] = (0.8, 1.2), shift: tuple[float, float] = (-0.2, 0.2),
    rotate: tuple[float, float] = (-45.0, 45.0), shear: tuple[float, float] = (-16.0, 16.0),
) -> DataFrame:
    """Scale, shift, rotate and shear about the patch centre, read back bilinearly; outside is 0. Patches are square; pixels they lack add nothing."""
    ids = _ids(keys)

    def draw(bounds: tuple[float, float], name: str) -> Column:
        return hash_range(*bounds, f"{seed}{name}", *ids)

    sx, sy = draw(scale, "sx"), draw(scale, "sy")
    angle, slant = F.radians(draw(rotate, "rot")), F.radians(draw(shear, "shear"))
    # the linear part [[sx·cos a, -sy·sin(a + s)], [sx·sin a, sy·cos(a + s)]], to be inverted
    draws = {
        "a": sx * F.cos(angle), "b": -sy * F.sin(angle + slant), "c": sx * F.sin(angle), "d": sy * F.cos(angle + slant),
        "tx": draw(shift, "tx") * size, "ty": draw(shift, "ty") * size}
    return _resampled(df, size, keys, values, draws, affine_positions, _chance(p, f"{seed}affine", keys))


def channel_multiply(
    df: DataFrame, seed: int, keys: list[str], bands: list[str], lo: float = 0.85, hi: float = 1.15, p: float = 0.3
) -> DataFrame:
    """Brightness factor per (patch, band); inputs only."""
    ids, chosen = _ids(keys), _chance(p, f"{seed}mul", keys)
    return df.withColumns({
        b: F.when(chosen, F.col(b) * hash_range(lo, hi, f"{seed}{b}", *ids)).otherwise(F.col(b)) for b in bands
    })


def blur(df: DataFrame, size: int, seed: int, keys: list[str], bands: list[str], sigma: float = 0.3, p: float = 0.3) -> DataFrame:
    """Gaussian blur of chosen patches with the given sigma, edges repeated; inputs only."""
    chosen = _chance(p, f"{seed}blur", keys)
    radius = max(1, math.ceil(4 * sigma))
    rest = [c for c in df.columns if c not in [*keys, "row", "col", *bands]]
    shaped = df.where(chosen).withColumns({"rows": F.lit(size), "cols": F.lit(size)})
    soft = convolve_separable(shaped, gaussian_weights(2 * radius + 1, sigma), bands, keys, carry=rest)
    return df.where(~chosen).unionByName(soft.select(*df.columns))
