"""Segmentation, counting and regression metrics as one aggregate each, with macro averages on top."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import ieee_divide
from ..functions.geometry import let
from .resample import convolve_separable, gaussian_weights


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _confusion_columns(truth: Column, pred: Column) -> dict[str, Column]:
    """Cell values with half-even rounding."""
    return {
        "tp": F.rint(truth * pred), "fp": F.rint((1 - truth) * pred),
        "tn": F.rint((1 - truth) * (1 - pred)), "fn": F.rint(truth * (1 - pred)),
    }


def confusion(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """TP, FP, TN and FN sums per key."""
    cells = _confusion_columns(_c(truth).cast("double"), _c(pred).cast("double"))
    return df.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in cells.items()])


def pixel_accuracy(truth: str, pred: str, rounded: bool = False) -> Column:
    t, p = (F.rint(truth), F.rint(pred)) if rounded else (_c(truth), _c(pred))
    return F.avg((t == p).cast("double"))


def dice(truth: str, pred: str) -> Column:
    """2Σtp / (Σt + Σp); 1 when both are empty."""
    t, p = F.sum(_c(truth)), F.sum(_c(pred))
    both = F.sum(F.abs(_c(truth) * _c(pred)))
    return F.when((t == 0) & (p == 0), F.lit(1.0)).otherwise(ieee_divide(2 * both, t + p))


def dice_smooth(truth: str, pred: str, smooth: float = 1e-7) -> Column:
    both = F.sum(F.abs(_c(truth) * _c(pred)))
    return (2 * both + F.lit(smooth)) / (F.sum(_c(truth)) + F.sum(_c(pred)) + F.lit(smooth))


def dice_loss(truth: str, pred: str) -> Column:
    return F.lit(1.0) - dice_smooth(truth, pred)


def sensitivity(tp: Column | str = "tp", fn: Column | str = "fn") -> Column:
    return ieee_divide(_c(tp), _c(tp) + _c(fn))


def specificity(tn: Column | str = "tn", fp: Column | str = "fp") -> Column:
    return ieee_divide(_c(tn), _c(tn) + _c(fp))


def mean_iou(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Mean over the two classes; a class neither side has is left out."""
    object_iou, ground_iou = F.try_divide(tp, tp + fp + fn), F.try_divide(tn, tn + fn + fp)
    n = object_iou.isNotNull().cast("int") + ground_iou.isNotNull().cast("int")
    return F.try_divide(F.coalesce(object_iou, F.lit(0.0)) + F.coalesce(ground_iou, F.lit(0.0)), n)


def weighted_mean_iou(df: DataFrame, keys: list[str], truth: str, pred: str, weight: str) -> DataFrame:
    """Class decisions truncate to integers, pixels count with their weight."""
    t, p, w = _c(truth).cast("int"), _c(pred).cast("int"), _c(weight)
    cells = df.groupBy(*keys).agg(
        F.sum(w * t * p).alias("tp"), F.sum(w * (1 - t) * p).alias("fp"),
        F.sum(w * (1 - t) * (1 - p)).alias("tn"), F.sum(w * t * (1 - p)).alias("fn"))
    return cells.select(*keys, mean_iou(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).alias("weighted_mean_iou"))


def tversky(truth: str, pred: str, weight: str, alpha: float = 0.6, beta: float = 0.4, eps: float = 1e-5) -> Column:
    """1 - tp / (tp + α·fp + β·fn + eps), weighted."""
    t, p, w = _c(truth), _c(pred), _c(weight)
    tp, fp, fn = F.sum(w * p * t), F.sum(w * p * (1 - t)), F.sum(w * (1 - p) * t)
    return F.lit(1.0) - tp / (tp + F.lit(alpha) * fp + F.lit(beta) * fn + F.lit(eps))


def segmentation_metrics(
    df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred", weight: str = "weight"
) -> DataFrame:
    """Accuracy, Tversky loss, dice, sensitivity, specificity and mean IoU per key, in one pass."""
    cells = _confusion_columns(_c(truth).cast("double"), _c(pred).cast("double"))
    sums = df.groupBy(*keys).agg(
        *[F.sum(v).alias(n) for n, v in cells.items()],
        pixel_accuracy(truth, pred).alias("accuracy"), tversky(truth, pred, weight).alias("loss"),
        dice(truth, pred).alias("dice"),
    )
    return sums.select(
        *keys, "accuracy", "loss", "dice", sensitivity().alias("sensitivity"), specificity().alias("specificity"),
        mean_iou(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).alias("mean_iou"),
    )


SEGMENTATION = ("accuracy", "loss", "dice", "sensitivity", "specificity", "mean_iou")


def macro_average(metrics: DataFrame, values: tuple[str, ...] = SEGMENTATION, keys: list[str] | None = None) -> DataFrame:
    """Mean of the per-image values, per model if ``keys`` says so."""
    return metrics.groupBy(*(keys or [])).agg(*[F.avg(v).alias(v) for v in values])


def pixel_errors(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    d = _c(pred) - _c(truth)
    mse = F.avg(d * d)
    return df.groupBy(*keys).agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def weighted_mae(
    df: DataFrame, truth: str, pred: str, clip: float = 10.0, wei: float = 5.0, keys: list[str] | None = None
) -> DataFrame:
    """Every pixel with its loss: the MAE of its key below the clip height, ``wei`` × that MAE above."""
    keys = keys or []
    mae = df.groupBy(*keys).agg(F.avg(F.abs(_c(pred) - _c(truth))).alias("_mae"))
    joined = df.join(mae, keys) if keys else df.withColumn("_mae", mae.scalar())
    loss = F.when(_c(truth) < F.lit(clip), F.col("_mae")).otherwise(F.lit(wei) * F.col("_mae"))
    return joined.withColumn("loss", loss).drop("_mae")


def density_loss(df: DataFrame, patch_keys: list[str], truth: str, pred: str, beta: float = 1e-4) -> DataFrame:
    """Pixel MSE + beta · MSE of the per-patch totals."""
    d = _c(pred) - _c(truth)
    per_patch = df.groupBy(*patch_keys).agg(
        F.sum(d * d).alias("sq"), F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"))
    return per_patch.agg(
        (F.sum("sq") / F.sum("n") + F.lit(beta) * F.avg(F.col("total") * F.col("total"))).alias("density_loss"))


def ssim(
    df: DataFrame, truth: str, pred: str, keys: list[str] | None = None, size: int = 11, sigma: float = 1.5,
    max_value: float = 1.0,
) -> DataFrame:
    """Mean structural similarity per key: Gaussian windows fully inside the raster, constants 0.01 and 0.03."""
    keys = keys or ["image_id"]
    x, y = _c(truth).cast("double"), _c(pred).cast("double")
    moments = df.select(
        *keys, "row", "col", "rows", "cols", x.alias("x"), y.alias("y"), (x * y).alias("xy"), (x * x + y * y).alias("q"))
    half = (size - 1) // 2
    local = convolve_separable(moments, gaussian_weights(size, sigma), ["x", "y", "xy", "q"], keys, edge="zero")
    local = local.where(
        F.col("row").between(half, F.col("rows") - 1 - half) & F.col("col").between(half, F.col("cols") - 1 - half))
    c1, c2 = F.lit((0.01 * max_value) ** 2), F.lit((0.03 * max_value) ** 2)
    mx, my = F.col("x"), F.col("y")
    light = (2 * mx * my + c1) / (mx * mx + my * my + c1)
    form = (2 * F.col("xy") - 2 * mx * my + c2) / (F.col("q") - mx * mx - my * my + c2)
    return local.groupBy(*keys).agg(F.avg(light * form).alias("ssim"))


def mse_ssim(df: DataFrame, truth: str, pred: str, delta: float = 0.01, keys: list[str] | None = None) -> DataFrame:
    """MSE + delta · (1 - mean SSIM)."""
    keys = keys or ["image_id"]
    similar = ssim(df, truth, pred, keys).agg((F.lit(delta) * (F.lit(1.0) - F.avg("ssim"))).alias("part"))
    d = _c(pred) - _c(truth)
    error = df.agg(F.avg(d * d).alias("part"))
    return error.unionByName(similar).agg(F.sum("part").alias("mse_ssim"))


# --- counts --------------------------------------------------------------------------------------------------


# fixed values: coefficients of the Lanczos approximation of the gamma function for g = 7, nine terms
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
BETA_STEPS = 500  # pairs of terms of the continued fraction; it settles after about the square root of the larger parameter


def _log_gamma(x: Column) -> Column:
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, folded from the front."""
    safe = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))

    def term(acc: Column, by: Column) -> Column:
        d = 1 / safe(1 + by * acc["d"])
        c = 1 + by / safe(acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def pair(acc: Column, step: Column) -> Column:
        m = step.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(term(acc, even), lambda half: term(half, odd))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BETA_STEPS)), start, pair)["h"]


def student_two_sided(t: Column, free: Column) -> Column:
    """P(|T| ≥ |t|) for Student's t with ``free`` degrees of freedom; NULL where there are none."""
    def of(v: Column) -> Column:
        a, b, x = v["a"], F.lit(0.5), v["x"]
        front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        near = front * _beta_fraction(a, b, x) / a
        far = 1 - front * _beta_fraction(b, a, 1 - x) / b
        return F.when(F.isnan(x), F.lit(float("nan"))).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(
            x < (a + 1) / (a + b + 2), near).otherwise(far)

    n = free.cast("double")
    share = F.when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(n / (n + t * t))
    return F.when((n > 0) & t.isNotNull(), let(F.struct((n / 2).alias("a"), share.alias("x")), of))


def linregress(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Least squares of y on x per key: slope, intercept, r, p and the slope's standard error."""
    keys = keys or []
    # the built-in regression aggregates take (dependent, independent)
    fit = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
    )
    r = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    free = F.col("n") - 2
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("r") * F.col("r"))
    fit = fit.withColumn("r", r).withColumn(
        "stderr", F.sqrt(F.try_divide(rest * F.try_divide(F.col("_syy"), F.col("_sxx")), free)))
    fit = fit.withColumn("t", ieee_divide(F.col("slope"), F.col("stderr"))).drop("_sxx", "_syy", "_sxy")
    p = F.when(~F.isnan("t"), student_two_sided(F.col("t"), F.col("n") - 2))
    return fit.withColumn("p", p).drop("t")


def count_errors(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """MAE, MAE over the mean truth, and the relative error of the total in percent."""
    d = _c(truth) - _c(pred)
    mae = F.avg(F.abs(d))
    return df.groupBy(*(keys or [])).agg(
        mae.alias("mae"), F.try_divide(mae, F.avg(truth)).alias("rmae"),
        (F.try_divide(F.abs(F.sum(d)), F.sum(truth)) * 100).alias("relative_total_error"))
