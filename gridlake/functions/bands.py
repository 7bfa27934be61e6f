"""Pixel-wise band arithmetic, normalisation, thresholds, scaling and casts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import floor_div
from .draws import hash01

NAN = float("nan")
EPSILON = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_divide(a: Column | str, b: Column | str) -> Column:
    """Floating division as array libraries do it: 0/0 is NaN, a/0 is signed infinity, NULL stays NULL."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    by_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(
        F.try_divide(a, b)
    )


def ndvi(nir: Column | str, red: Column | str) -> Column:
    """(nir - red) / (nir + red)."""
    nir, red = _c(nir).cast("double"), _c(red).cast("double")
    return ieee_divide(nir - red, nir + red)


def rgb_to_gray(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Luma with the fixed weights 0.2989, 0.5870, 0.1140."""
    return F.lit(0.2989) * _c(r) + F.lit(0.5870) * _c(g) + F.lit(0.1140) * _c(b)


def nanmean(columns: list[Column]) -> Column:
    """Mean of several columns of one row without the NaN ones; all NaN gives NaN."""
    kept = [F.when(F.isnan(c) | c.isNull(), F.lit(0.0)).otherwise(c) for c in columns]
    used = [F.when(F.isnan(c) | c.isNull(), F.lit(0)).otherwise(F.lit(1)) for c in columns]
    total, n = kept[0], used[0]
    for k, u in zip(kept[1:], used[1:]):
        total, n = total + k, n + u
    return F.when(n == 0, F.lit(NAN)).otherwise(F.try_divide(total, n))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# --- normalisation -----------------------------------------------------------------------


def zscore(x: Column | str, mean: Column | str, std: Column | str, eps: float = EPSILON) -> Column:
    """(x - mean) / (std + eps) with the population deviation."""
    if eps > 0:  # the divisor is never 0, so the plain division does
        return (_c(x) - _c(mean)) / (_c(std) + F.lit(eps))
    return ieee_divide(_c(x) - _c(mean), _c(std))


def _join_stats(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregate per key (partial sums before the shuffle) and bring the one row per key back."""
    return df.join(df.groupBy(*keys).agg(*aggregates), keys)


STATS_BLOCK = 512  # pixels; side of the blocks to which the statistics of an image are handed out


def _join_image_stats(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Statistics of whole images, handed to the image's blocks and joined there: no shuffle gathers the pixels of an image."""
    block = {"_sr": floor_div(F.col("row"), STATS_BLOCK), "_sc": floor_div(F.col("col"), STATS_BLOCK)}
    placed = df.withColumns(block)
    stats = df.groupBy(*keys).agg(*aggregates)
    handed = placed.select(*keys, "_sr", "_sc").distinct().join(stats, keys)
    return placed.join(handed, [*keys, "_sr", "_sc"]).drop("_sr", "_sc")


def normalize_patch(df: DataFrame, keys: list[str], bands: list[str], eps: float = EPSILON) -> DataFrame:
    """z-score of each band over the rows of a window; rows are valid pixels only, before padding."""
    aggs = [F.avg(b).alias(f"_m_{b}") for b in bands] + [F.stddev_pop(b).alias(f"_s_{b}") for b in bands]
    out = _join_stats(df, keys, aggs)
    for b in bands:
        out = out.withColumn(b, zscore(b, f"_m_{b}", f"_s_{b}", eps))
    return out.drop(*[f"_m_{b}" for b in bands], *[f"_s_{b}" for b in bands])


def normalize_tile(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """z-score with the statistics of the whole image and no epsilon."""
    aggs = [F.avg(b).alias(f"_m_{b}") for b in bands] + [F.stddev_pop(b).alias(f"_s_{b}") for b in bands]
    out = _join_image_stats(df, keys or ["image_id"], aggs)
    out = out.withColumns({b: zscore(b, f"_m_{b}", f"_s_{b}", 0.0) for b in bands})
    return out.drop(*[f"_m_{b}" for b in bands], *[f"_s_{b}" for b in bands])


@dataclass(frozen=True)
class Preset:
    """Per-band constants: (x / scale - mean) / divisor."""

    bands: tuple[str, ...]
    scale: float
    mean: tuple[float, ...]
    divisor: tuple[float, ...]


# They must equal the published normalisation constants.
PRESETS = {
    "five_band": Preset(("red", "green", "blue", "infrared", "ndvi"), 255.0,
                        (0.317, 0.350, 0.321, 0.560, 0.0), (0.985, 0.895, 0.703, 1.107, 1.0)),
    "green_blue_nir": Preset(("green", "blue", "infrared"), 255.0,
                             (0.350, 0.321, 0.560), (0.895, 0.703, 1.107)),
    "finland": Preset(("green", "blue", "infrared"), 255.0,
                      (0.253, 0.300, 0.321), (0.122, 0.118, 0.127)),
    "rgb": Preset(("red", "green", "blue"), 255.0, (0.317, 0.350, 0.321), (0.985, 0.895, 0.703)),
    "height_training": Preset(("red", "green", "blue", "infrared", "ndvi"), 255.0,
                              (0.31, 0.37, 0.34, 0.63, 0.0), (0.83, 0.74, 0.52, 0.81, 1.0)),
    "two_resolution": Preset(("red", "green", "blue", "infrared", "ndvi"), 1.0,
                             (118.66, 121.69, 107.15, 178.43, 0.0), (29.32, 26.32, 25.42, 24.28, 1.0)),
    "two_resolution_height": Preset(("height",), 1.0, (3.5,), (3.0,)),
    "robust": Preset(("green", "blue", "infrared"), 1.0, (73.0, 72.0, 145.0), (40.0, 24.0, 37.0)),
}

#: fixed values: target range of the min-max step, low and width per band
MINMAX_TARGET = {"green": (0.0, 255.0), "blue": (0.0, 255.0), "infrared": (139.0, 116.0)}


def normalize_global(df: DataFrame, preset: str | Preset, bands: list[str] | None = None) -> DataFrame:
    """Constants only: stays in the scan's stage. ``bands`` renames the preset's bands to columns of ``df``."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    names = bands or list(p.bands)
    return df.withColumns({
        b: (_c(b) / F.lit(p.scale) - F.lit(m)) / F.lit(d) for b, m, d in zip(names, p.mean, p.divisor)
    })


def robust_scale_local(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """(x - q25) / (q75 - q25) per window and band, quartiles exact with linear interpolation."""
    aggs = [F.percentile(b, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{b}") for b in bands]
    out = _join_stats(df, keys, aggs)
    for b in bands:
        q1, q3 = F.col(f"_q_{b}")[0], F.col(f"_q_{b}")[1]
        out = out.withColumn(b, ieee_divide(_c(b) - q1, q3 - q1))
    return out.drop(*[f"_q_{b}" for b in bands])


#: Distinct values of one band that one task may order, and ranks that the sketch tells apart.
MOST_VALUES, RANKS = 1 << 16, 10_000


def _ranked(df: DataFrame, wanted: dict[int, tuple[str, int]], most: int, ranks: int) -> dict[int, float]:
    """The value at a 0-based rank among the numbers of a band, for each of ``wanted``.

    A sketch gives two values that the rank surely lies between, one pass counts what lies below and between; that is repeated inside until few
    distinct values are left, and these are counted and ordered. Each round leaves a few thousandths, so three are enough for any raster.
    """
    number = lambda b: F.when(~F.isnan(_c(b).cast("double")), _c(b).cast("double"))
    between = {k: (float("-inf"), float("inf")) for k in wanted}
    inside = lambda k: F.when(number(wanted[k][0]).between(F.lit(between[k][0]), F.lit(between[k][1])), number(wanted[k][0]))
    last = None
    while True:
        counts = df.agg(*[f.alias(f"{name}{k}") for k, (b, _) in wanted.items() for name, f in (
            ("below", F.count(F.when(number(b) < F.lit(between[k][0]), 1))), ("n", F.count(inside(k))))]).first()
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), inside(k).alias("v")) for k in wanted])).alias("p")
        values = df.select(pairs).where(F.col("p.v").isNotNull()).groupBy("p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))
        crowded = {r["k"] for r in values.groupBy("k").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most).collect()}
        if not crowded or last == between:
            break
        last = dict(between)
        shares = {}
        for k in crowded:
            at = (wanted[k][1] - counts[f"below{k}"]) / max(counts[f"n{k}"] - 1, 1)
            shares[k] = [min(1.0, max(0.0, at + d)) for d in (-3 / ranks, 3 / ranks)]
        found = df.agg(*[F.percentile_approx(inside(k), s, ranks).alias(f"q{k}") for k, s in shares.items()]).first()
        for k in crowded:
            between[k] = (found[f"q{k}"][0] if shares[k][0] > 0 else between[k][0], found[f"q{k}"][1] if shares[k][1] < 1 else between[k][1])
    order = Window.partitionBy("k").orderBy("v")
    seen = values.withColumn("upto", F.sum("n").over(order))
    rank = F.element_at(F.create_map(*[F.lit(x) for k, (_, r) in wanted.items() for x in (k, r - counts[f"below{k}"])]), F.col("k"))
    hit = seen.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    return {r["k"]: r["v"] for r in hit.collect()}  # one row for each rank


def global_quartiles(df: DataFrame, bands: list[str], most: int = MOST_VALUES, ranks: int = RANKS) -> DataFrame:
    """Exact quartiles of whole bands with linear interpolation: (band, q1, q3); a band without values gives no row.

    Nulls are left out, NaN ranks above every number. No task orders more than ``most`` distinct values of a band, whatever the band's type.
    """
    n = df.agg(*[f.alias(f"{name}{i}") for i, b in enumerate(bands) for name, f in (
        ("n", F.count(b)), ("nan", F.count(F.when(F.isnan(_c(b).cast("double")), 1))))]).first()
    places, wanted = {}, {}
    for i, b in enumerate(bands):
        for share in (0.25, 0.75):
            at = (n[f"n{i}"] - 1) * share
            places[b, share] = [(int(at) + d, 1 - (at - int(at)) if d == 0 else at - int(at)) for d in (0, 1)]
            for rank, weight in places[b, share]:
                if weight > 0 and rank < n[f"n{i}"] - n[f"nan{i}"]:
                    wanted[len(wanted)] = (b, rank)
    value = {wanted[k]: v for k, v in _ranked(df, wanted, most, ranks).items()} if wanted else {}
    rows = []
    for i, b in enumerate(bands):
        if n[f"n{i}"]:
            q = [sum(w * value.get((b, r), float("nan")) for r, w in places[b, s] if w > 0) for s in (0.25, 0.75)]
            rows.append((b, float(q[0]), float(q[1])))
    return df.sparkSession.createDataFrame(rows, "band string, q1 double, q3 double")


def robust_scale_global(df: DataFrame, quartiles: dict[str, tuple[float, float]]) -> DataFrame:
    """Same scaling with given quartiles per band."""
    return df.withColumns({b: ieee_divide(_c(b) - F.lit(q1), F.lit(q3 - q1)) for b, (q1, q3) in quartiles.items()})


def minmax_rescale(
    df: DataFrame, keys: list[str], target: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Maps [min, max] of each band and key to low + [0, width]."""
    target = target or MINMAX_TARGET
    aggs = [F.min(b).alias(f"_lo_{b}") for b in target] + [F.max(b).alias(f"_hi_{b}") for b in target]
    out = _join_image_stats(df, keys, aggs)
    for b, (low, width) in target.items():
        unit = ieee_divide(_c(b) - _c(f"_lo_{b}"), _c(f"_hi_{b}") - _c(f"_lo_{b}"))
        out = out.withColumn(b, F.lit(low) + unit * F.lit(width))
    return out.drop(*[f"_lo_{b}" for b in target], *[f"_hi_{b}" for b in target])


def unit_scale_then_zscore(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """x / 255, then the window z-score."""
    return normalize_patch(df.withColumns({b: _c(b) / F.lit(255.0) for b in bands}), keys, bands)


def maybe_normalize(df: DataFrame, p: float, seed: int, keys: list[str], bands: list[str]) -> DataFrame:
    """Normalises a whole patch with probability ``p``; one draw per patch key."""
    raw = {f"_raw_{b}": _c(b) for b in bands}
    out = normalize_patch(df.withColumns(raw), keys, bands)
    chosen = hash01(seed, *[_c(k) for k in keys]) <= F.lit(float(p))
    out = out.withColumns({b: F.when(chosen, _c(b)).otherwise(_c(f"_raw_{b}")) for b in bands})
    return out.drop(*raw)


# --- heights, thresholds, types -------------------------------------------------------------

MAX_HEIGHT = 97.19  # fixed value: highest canopy of the training area, metres


def height_scale(x: Column | str, mode: str) -> Column:
    """``detected``: /100 with values below 1 zeroed; ``unit`` / ``metres``: ÷ / × 97.19; ``centi`` ×100; ``fixed`` ×10000."""
    x = _c(x)
    if mode == "detected":
        metres = x / F.lit(100.0)
        return F.when(metres < 1, F.lit(0.0)).otherwise(metres)
    factors = {"unit": 1 / MAX_HEIGHT, "metres": MAX_HEIGHT, "centi": 100.0, "fixed": 10000.0}
    if mode == "unit":
        return x / F.lit(MAX_HEIGHT)
    return x * F.lit(factors[mode])


def threshold(x: Column | str, th: float = 0.5) -> Column:
    """1 where x >= th, else 0. NaN is no object, although Spark ranks it above every number."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(0)).when(x >= F.lit(float(th)), F.lit(1)).otherwise(F.lit(0))


def clip_negative(x: Column | str) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


_RANGES = {"uint8": ("smallint", 0, 255), "int16": ("smallint", -32768, 32767)}


def cast_dtype(x: Column | str, dtype: str) -> Column:
    """uint8 / int16 truncate towards zero and clamp; NaN becomes 0. float32 / float64 are plain casts."""
    x = _c(x)
    if dtype in _RANGES:
        spark_type, lo, hi = _RANGES[dtype]
        safe = F.when(F.isnan(x.cast("double")), F.lit(0.0)).otherwise(x.cast("double"))
        return F.least(F.greatest(safe, F.lit(float(lo))), F.lit(float(hi))).cast(spark_type)
    return x.cast({"float32": "float", "float64": "double"}[dtype])
