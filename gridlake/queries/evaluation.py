"""Queries over objects, counts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics as m, objects as ob
from ..plans import evaluation as ev
from . import fixtures as fx
from .fixtures import SIDE, r6 as R, with_ctes
from .registry import query, r6

BLOCK = 32


def R10(x: str):
    """Ten decimals: means of per-image shares end within them, so none falls on a rounding tie."""
    return F.round(x, 10)


def r10(expression: str) -> str:
    return f"(round({expression}, 10) + 0.0::DOUBLE)"


# --- objects -------------------------------------------------------------------------------------------------

_COMPONENTS = [
    ("obs", "SELECT image_id, row, col FROM obj WHERE mask = 1"),
    ("reach", """
      SELECT image_id, row, col, row AS r0, col AS c0 FROM obs
      UNION
      SELECT o.image_id, o.row, o.col, s.r0, s.c0 FROM reach s JOIN obs o ON o.image_id = s.image_id
        AND abs(o.row - s.row) <= 1 AND abs(o.col - s.col) <= 1"""),
    ("comp", """SELECT image_id, row, col, min(struct_pack(r := r0, c := c0)) AS root FROM reach GROUP BY image_id, row, col"""),
    ("square", """
      SELECT image_id, root, row - a.range AS r, col - b.range AS c, count(*) AS n FROM comp, range(2) a, range(2) b GROUP BY ALL"""),
    ("area", """
      SELECT image_id, root, CAST(sum(n) // 4 AS BIGINT) AS px_area,
        sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS contour_area FROM square GROUP BY image_id, root"""),
]


def _on(spark: SparkSession, sf: str) -> DataFrame:
    return fx.object_mask(spark, sf).where(F.col("mask") == 1)


@query(with_ctes(["obj"], "SELECT image_id, row, col, root.r AS root_row, root.c AS root_col FROM comp", True, _COMPONENTS))
def components(spark: SparkSession, sf: str) -> DataFrame:
    """8-connected objects, labelled in blocks of 32 and joined across block borders."""
    c = ob.label_components(_on(spark, sf), block=BLOCK)
    return c.select("image_id", "row", "col", F.col("component.row").alias("root_row"), F.col("component.col").alias("root_col"))


@query(with_ctes(["obj"], "SELECT image_id, count(DISTINCT root) AS n_objects FROM comp GROUP BY image_id", True, _COMPONENTS))
def count_components(spark: SparkSession, sf: str) -> DataFrame:
    return ob.count_components(ob.label_components(_on(spark, sf), block=BLOCK))


_HOLES = [
    ("back", "SELECT image_id, row, col FROM obj WHERE mask = 0"),
    ("flood", f"""
      SELECT image_id, row, col FROM back WHERE row IN (0, {SIDE - 1}) OR col IN (0, {SIDE - 1})
      UNION
      SELECT b.image_id, b.row, b.col FROM flood f JOIN back b ON b.image_id = f.image_id AND abs(b.row - f.row) + abs(b.col - f.col) = 1"""),
    ("inner_px", "SELECT * FROM back ANTI JOIN flood USING (image_id, row, col)"),
    ("hole", """
      SELECT image_id, row, col, row AS r0, col AS c0 FROM inner_px
      UNION
      SELECT o.image_id, o.row, o.col, s.r0, s.c0 FROM hole s JOIN inner_px o ON o.image_id = s.image_id
        AND abs(o.row - s.row) + abs(o.col - s.col) = 1"""),
    ("hroot", "SELECT image_id, row, col, min(struct_pack(r := r0, c := c0)) AS root FROM hole GROUP BY image_id, row, col"),
]


@query(with_ctes(["obj"], "SELECT image_id, count(DISTINCT root) AS n_holes FROM hroot GROUP BY image_id", True, _HOLES))
def count_holes(spark: SparkSession, sf: str) -> DataFrame:
    return ob.count_holes(fx.object_mask(spark, sf), "mask", block=BLOCK)


@query(with_ctes(["obj"], """
    SELECT image_id, CAST(sum(n) AS BIGINT) AS n_contours FROM (
      SELECT image_id, count(DISTINCT root) AS n FROM comp GROUP BY image_id
      UNION ALL SELECT image_id, count(DISTINCT root) FROM hroot GROUP BY image_id) GROUP BY image_id""", True, _COMPONENTS + _HOLES))
def contour_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Objects plus holes, as a contour tree counts them."""
    return ev.contour_counts(fx.object_mask(spark, sf), "mask", ["image_id"], BLOCK)


@query(with_ctes(["obj"], """
    SELECT image_id, root.r AS root_row, root.c AS root_col, px_area, contour_area FROM area""", True, _COMPONENTS))
def object_area(spark: SparkSession, sf: str) -> DataFrame:
    a = ob.object_area(ob.label_components(_on(spark, sf), block=BLOCK))
    return a.select("image_id", F.col("component.row").alias("root_row"), F.col("component.col").alias("root_col"),
                    "px_area", "contour_area")


#: Contours of objects (kind 0) and holes (kind 1) with all that lies inside: the one that encloses a component lies above its first pixel.
_CONTOURS = [
    ("part", "SELECT image_id, row, col, 0 AS kind, root FROM comp UNION ALL SELECT image_id, row, col, 1, root FROM hroot"),
    ("link", """
      SELECT i.image_id, i.kind, i.root, o.kind AS pkind, o.root AS proot FROM part i JOIN part o ON o.image_id = i.image_id AND o.kind <> i.kind
        AND o.row = i.row - 1 AND o.col = i.col WHERE i.row = i.root.r AND i.col = i.root.c"""),
    ("enclosing", """
      SELECT DISTINCT image_id, kind, root, kind AS akind, root AS aroot FROM part
      UNION
      SELECT e.image_id, e.kind, e.root, l.pkind, l.proot FROM enclosing e JOIN link l ON l.image_id = e.image_id AND l.kind = e.akind AND l.root = e.aroot"""),
    ("inside", """
      SELECT p.image_id, e.akind AS kind, e.aroot AS root, p.row, p.col FROM part p JOIN enclosing e USING (image_id, kind, root)
      UNION
      SELECT image_id, 1, root, row + d.r, col + d.c FROM hroot, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(r, c)"""),
    ("csquare", """
      SELECT image_id, kind, root, row - a.range AS r, col - b.range AS c, count(*) AS n FROM inside, range(2) a, range(2) b GROUP BY ALL"""),
    ("carea", """
      SELECT image_id, kind, root, CAST(sum(n) // 4 AS BIGINT) AS px_area,
        sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS contour_area FROM csquare GROUP BY image_id, kind, root"""),
]
_ALL_CONTOURS = _COMPONENTS + _HOLES + _CONTOURS


@query(with_ctes(["obj"], """
    SELECT image_id, root.r AS root_row, root.c AS root_col, kind, px_area, contour_area FROM carea""", True, _ALL_CONTOURS))
def contour_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines of objects and holes with what they enclose, holes in objects and objects in holes included."""
    a = ob.contour_measures(ob.contour_tree(fx.object_mask(spark, sf), "mask", block=BLOCK))
    low = F.col("contour").bitwiseAND(F.lit((1 << 32) - 1))
    return a.select(
        "image_id", F.shiftright("contour", 32).cast("int").alias("root_row"), F.shiftright(low, 1).cast("int").alias("root_col"),
        low.bitwiseAND(F.lit(1)).cast("int").alias("kind"), "px_area", "contour_area")


@query(with_ctes(["obj"], """
    SELECT image_id, row, col FROM comp ANTI JOIN (
      SELECT i.image_id, i.row, i.col FROM inside i JOIN carea a USING (image_id, kind, root) WHERE contour_area < 2) USING (image_id, row, col)""",
                 True, _ALL_CONTOURS))
def remove_small(spark: SparkSession, sf: str) -> DataFrame:
    return ob.remove_small(fx.object_mask(spark, sf), "mask", 2, block=BLOCK)[0].select("image_id", "row", "col")


@query(with_ctes(["obj"], """
    SELECT image_id, count(*) AS n_before, count(*) FILTER (px_area >= 3) AS n_after FROM carea GROUP BY image_id""", True, _ALL_CONTOURS))
def remove_small_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ob.remove_small(fx.object_mask(spark, sf), "mask", 3, measure="px_area", block=BLOCK)[1]


@query(with_ctes(["obj"], f"""
    SELECT count(*) AS n_before, count(*) FILTER (contour_area >= 2) AS n_after,
      {r6('(count(*) - count(*) FILTER (contour_area >= 2)) / count(*)')} AS decrease FROM carea""", True, _ALL_CONTOURS))
def count_drop(spark: SparkSession, sf: str) -> DataFrame:
    return ob.count_drop(ob.remove_small(fx.object_mask(spark, sf), "mask", 2, block=BLOCK)[1]).withColumn("decrease", R("decrease"))


@query(with_ctes(["tp"], f"SELECT image_id, {r6('sum(greatest(dens, 0))')} AS n_objects FROM tp GROUP BY image_id"))
def count_by_density(spark: SparkSession, sf: str) -> DataFrame:
    out = ob.count_by_density(fx.truth_pred(spark, sf), density="dens")
    return out.withColumn("n_objects", R("n_objects"))


@query(with_ctes(["tp"], f"""
    SELECT image_id, CAST(sum(pred) AS BIGINT) AS pred_px, CAST(sum(truth) AS BIGINT) AS truth_px,
      CASE WHEN sum(truth) = 0 THEN NULL ELSE {r6('sum(pred) / sum(truth)')} END AS ratio FROM tp GROUP BY image_id"""))
def cover_area(spark: SparkSession, sf: str) -> DataFrame:
    return ob.cover_area(fx.truth_pred(spark, sf), "pred", "truth", ["image_id"]).withColumn("ratio", R("ratio"))


@query(with_ctes(["tp"], f"SELECT image_id, row // 16 AS pr, col // 16 AS pc, {r6('sum(truth_dens)')} AS object_count FROM tp GROUP BY ALL"))
def frame_object_count(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.truth_pred(spark, sf).withColumns({"pr": F.floor(F.col("row") / 16), "pc": F.floor(F.col("col") / 16)})
    out = ob.frame_object_count(t, "truth_dens", ["image_id", "pr", "pc"])
    return out.withColumn("object_count", R("object_count"))


# --- segmentation metrics ------------------------------------------------------------------------------------------

_CELLS = """
    sum(round_even(truth * pred, 0))::DOUBLE AS tp, sum(round_even((1 - truth) * pred, 0))::DOUBLE AS fp,
    sum(round_even((1 - truth) * (1 - pred), 0))::DOUBLE AS tn, sum(round_even(truth * (1 - pred), 0))::DOUBLE AS fn"""

_METRICS = ("met", f"""
    SELECT image_id, accuracy, loss, dice, CASE WHEN tp + fn = 0 THEN 'NaN'::DOUBLE ELSE tp / (tp + fn) END AS sensitivity,
      CASE WHEN tn + fp = 0 THEN 'NaN'::DOUBLE ELSE tn / (tn + fp) END AS specificity,
      CASE WHEN tp + fp + fn = 0 THEN tn / (tn + fp + fn) WHEN tn + fp + fn = 0 THEN tp / (tp + fp + fn)
        ELSE (tp / (tp + fp + fn) + tn / (tn + fp + fn)) / 2 END AS mean_iou
    FROM (SELECT image_id, {_CELLS}, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
            1 - sum(weight * pred * truth) / (sum(weight * pred * truth) + 0.6::DOUBLE * sum(weight * pred * (1 - truth))
              + 0.4::DOUBLE * sum(weight * (1 - pred) * truth) + 1e-5) AS loss,
            CASE WHEN sum(truth) = 0 AND sum(pred) = 0 THEN 1 ELSE 2 * sum(truth * pred) / (sum(truth) + sum(pred)) END AS dice
          FROM tp GROUP BY image_id)""")


@query(with_ctes(["tp"], f"SELECT image_id, {_CELLS} FROM tp GROUP BY image_id"))
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return m.confusion(fx.truth_pred(spark, sf), ["image_id"])


@query(with_ctes(["tp"], f"""
    SELECT image_id, sum(round_even(truth * score, 0)) AS tp, sum(round_even((1 - truth) * score, 0)) AS fp,
      sum(round_even((1 - truth) * (1 - score), 0)) AS tn, sum(round_even(truth * (1 - score), 0)) AS fn
    FROM (SELECT * REPLACE (round(score, 9) AS score) FROM tp) GROUP BY image_id"""))
def confusion_soft(spark: SparkSession, sf: str) -> DataFrame:
    """Half-even rounding of scores that are not yet 0 or 1."""
    return m.confusion(fx.truth_pred(spark, sf).withColumn("score", F.round("score", 9)), ["image_id"], pred="score")


def _show(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.isnan(c), F.lit(-1.0)).otherwise(R10(c)) for c in columns})


_NAMES = list(m.SEGMENTATION)


@query(with_ctes(["tp"], "SELECT image_id, " + ", ".join(
    f"CASE WHEN isnan({c}) THEN -1 ELSE {r10(c)} END AS {c}" for c in _NAMES) + " FROM met", extra=[_METRICS]))
def segmentation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics per image; the empty twins have no sensitivity (shown as -1)."""
    return _show(m.segmentation_metrics(fx.truth_pred(spark, sf), ["image_id"]), _NAMES)


@query(with_ctes(["tp"], f"SELECT image_id, {r6('mean_iou')} AS mean_iou, {r6('loss')} AS tversky FROM met", extra=[_METRICS]))
def mean_iou_and_tversky(spark: SparkSession, sf: str) -> DataFrame:
    out = m.segmentation_metrics(fx.truth_pred(spark, sf), ["image_id"])
    return out.select("image_id", R("mean_iou").alias("mean_iou"), R("loss").alias("tversky"))


@query(with_ctes(["tp"], "SELECT " + ", ".join(
    f"{r10(f'avg({c})')} AS {c}" for c in _NAMES if c != "sensitivity") + " FROM met", extra=[_METRICS]))
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    names = tuple(c for c in _NAMES if c != "sensitivity")
    out = m.macro_average(m.segmentation_metrics(fx.truth_pred(spark, sf), ["image_id"]), names)
    return out.select(*[R10(c).alias(c) for c in names])


@query(with_ctes(["tp"], f"""
    SELECT image_id, {r6('avg(CASE WHEN round_even(truth, 0) = round_even(round(score, 9), 0) THEN 1.0 ELSE 0.0 END)')} AS accuracy,
      {r6('(2 * sum(abs(truth * score)) + 1e-7) / (sum(truth) + sum(score) + 1e-7)')} AS dice_smooth,
      {r6('1 - (2 * sum(abs(truth * score)) + 1e-7) / (sum(truth) + sum(score) + 1e-7)')} AS dice_loss FROM tp GROUP BY image_id"""))
def soft_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.truth_pred(spark, sf).withColumns({"s9": F.round("score", 9), "t": F.col("truth").cast("double")})
    return t.groupBy("image_id").agg(
        R(m.pixel_accuracy("t", "s9", rounded=True)).alias("accuracy"),
        R(m.dice_smooth("truth", "score")).alias("dice_smooth"), R(m.dice_loss("truth", "score")).alias("dice_loss"))


@query(with_ctes(["tp"], f"""
    SELECT image_id, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE {r6('(tp / (tp + fp + fn) + tn / (tn + fp + fn)) / 2')} END AS weighted_mean_iou
    FROM (SELECT image_id, sum(weight * truth * pred) AS tp, sum(weight * (1 - truth) * pred) AS fp,
            sum(weight * (1 - truth) * (1 - pred)) AS tn, sum(weight * truth * (1 - pred)) AS fn FROM tp GROUP BY image_id)"""))
def weighted_mean_iou(spark: SparkSession, sf: str) -> DataFrame:
    out = m.weighted_mean_iou(fx.truth_pred(spark, sf), ["image_id"], "truth", "pred", "weight")
    return out.withColumn("weighted_mean_iou", R("weighted_mean_iou"))


@query(with_ctes(["tp"], f"""
    SELECT image_id, {r6('avg((dens - truth_dens) * (dens - truth_dens))')} AS mse, {r6('sqrt(avg((dens - truth_dens) * (dens - truth_dens)))')} AS rmse,
      {r6('avg(abs(dens - truth_dens))')} AS mae FROM tp GROUP BY image_id"""))
def pixel_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = m.pixel_errors(fx.truth_pred(spark, sf), ["image_id"], "truth_dens", "dens")
    return out.select("image_id", *[R(c).alias(c) for c in ("mse", "rmse", "mae")])


@query(with_ctes(["px"], f"""
    SELECT image_id, row, col, CASE WHEN red / 12 < 10 THEN mae ELSE {r6('5 * m')} END AS loss
    FROM (SELECT *, {r6('m')} AS mae FROM (SELECT *, avg(abs(green / 12 - red / 12)) OVER () AS m FROM px))"""))
def weighted_mae(spark: SparkSession, sf: str) -> DataFrame:
    h = fx.pixels(spark, sf).select("image_id", "row", "col", (F.col("red") / 12).alias("t"), (F.col("green") / 12).alias("p"))
    return m.weighted_mae(h, "t", "p").select("image_id", "row", "col", R("loss").alias("loss"))


@query(with_ctes(["tp"], f"""
    SELECT {r6('sum(sq) / sum(n) + 1e-4 * avg(t * t)')} AS density_loss FROM (
      SELECT image_id, sum((dens - truth_dens) * (dens - truth_dens)) AS sq, count(*) AS n, sum(dens - truth_dens) AS t FROM tp GROUP BY image_id)"""))
def density_loss(spark: SparkSession, sf: str) -> DataFrame:
    return m.density_loss(fx.truth_pred(spark, sf), ["image_id"], "truth_dens", "dens").select(R("density_loss").alias("density_loss"))


_SSIM = [("g", f"""SELECT CAST(range AS INTEGER) AS k, exp(-(range - 5) * (range - 5) / 4.5::DOUBLE)
            / sum(exp(-(range - 5) * (range - 5) / 4.5::DOUBLE)) OVER () AS w FROM range(11)"""),
         ("base", "SELECT image_id, row, col, red / 255 AS x, green / 255 AS y FROM px"),
         ("rowpass", f"""SELECT b.image_id, b.row - k AS row, b.col, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * y) AS xy, sum(w * (x * x + y * y)) AS q
            FROM base b, g WHERE b.row - k BETWEEN 0 AND {SIDE - 11} GROUP BY 1, 2, 3"""),
         ("local", f"""SELECT image_id, row, col - k AS col, sum(w * x) AS x, sum(w * y) AS y, sum(w * xy) AS xy, sum(w * q) AS q
            FROM rowpass, g WHERE col - k BETWEEN 0 AND {SIDE - 11} GROUP BY 1, 2, 3"""),
         ("ss", """SELECT image_id, avg((2 * x * y + 0.0001::DOUBLE) / (x * x + y * y + 0.0001::DOUBLE)
            * (2 * xy - 2 * x * y + 0.0009::DOUBLE) / (q - x * x - y * y + 0.0009::DOUBLE)) AS ssim FROM local GROUP BY image_id""")]


@query(with_ctes(["px"], f"SELECT image_id, {r6('ssim')} AS ssim FROM ss", extra=_SSIM))
def ssim(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.sized_pixels(spark, sf).withColumns({"x": F.col("red") / 255, "y": F.col("green") / 255})
    return m.ssim(px, "x", "y").withColumn("ssim", R("ssim"))


@query(with_ctes(["px"], f"""
    SELECT {r6('(SELECT avg((y - x) * (y - x)) FROM base) + 0.01::DOUBLE * (1 - (SELECT avg(ssim) FROM ss))')} AS mse_ssim""", extra=_SSIM))
def mse_ssim(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.sized_pixels(spark, sf).withColumns({"x": F.col("red") / 255, "y": F.col("green") / 255})
    return m.mse_ssim(px, "x", "y").select(R("mse_ssim").alias("mse_ssim"))


# --- counts against truth ----------------------------------------------------------------------------------------------

_COUNTS = ("rc", """
    SELECT image_id, sum(greatest(dens, 0)) AS pred_count, sum(truth_dens) AS truth_count, count(*) AS n_px,
      count(*) * 0.04::DOUBLE AS area_m2, sum(greatest(dens, 0)) / (count(*) * 0.04::DOUBLE) * 10000 AS pred_per_ha,
      sum(truth_dens) / (count(*) * 0.04::DOUBLE) * 10000 AS truth_per_ha FROM tp GROUP BY image_id""")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.truth_pred(spark, sf)
    keys = ["image_id", "row", "col"]
    return ev.report_count(t.select(*keys, F.col("dens").alias("density")), t.select(*keys, F.col("truth_dens").alias("density")))


@query(with_ctes(["tp"], f"""
    SELECT image_id, {r6('pred_count')} AS pred_count, {r6('truth_count')} AS truth_count, n_px, {r6('area_m2')} AS area_m2,
      {r6('pred_per_ha')} AS pred_per_ha, {r6('truth_per_ha')} AS truth_per_ha FROM rc""", extra=[_COUNTS]))
def report_count(spark: SparkSession, sf: str) -> DataFrame:
    out = _counts(spark, sf)
    return out.withColumns({c: R(c) for c in ("pred_count", "truth_count", "area_m2", "pred_per_ha", "truth_per_ha")})


@query(with_ctes(["tp"], f"""
    SELECT count(*) AS n, {r6('regr_slope(pred_per_ha, truth_per_ha)')} AS slope, {r6('regr_intercept(pred_per_ha, truth_per_ha)')} AS intercept,
      {r6('corr(pred_per_ha, truth_per_ha)')} AS r,
      {r6('sqrt((1 - pow(corr(pred_per_ha, truth_per_ha), 2)) * regr_syy(pred_per_ha, truth_per_ha) / regr_sxx(pred_per_ha, truth_per_ha) / (count(*) - 2))')} AS stderr
    FROM rc""", extra=[_COUNTS]))
def count_regression(spark: SparkSession, sf: str) -> DataFrame:
    fit = ev.count_summary(_counts(spark, sf))[0]
    return fit.select("n", *[R(c).alias(c) for c in ("slope", "intercept", "r", "stderr")])


@query(with_ctes(["tp"], f"""
    SELECT {r6('avg(abs(truth_per_ha - pred_per_ha))')} AS mae, {r6('avg(abs(truth_per_ha - pred_per_ha)) / avg(truth_per_ha)')} AS rmae,
      {r6('abs(sum(truth_per_ha - pred_per_ha)) / sum(truth_per_ha) * 100')} AS relative_total_error FROM rc""", extra=[_COUNTS]))
def count_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.count_summary(_counts(spark, sf))[1]
    return out.select(*[R(c).alias(c) for c in ("mae", "rmae", "relative_total_error")])


# customers and their orders as a regression with hundreds of groups
@query(f"""
    SELECT c_nationkey, count(*) AS n, {r6('regr_slope(c_acctbal, c_custkey)')} AS slope, {r6('corr(c_acctbal, c_custkey)')} AS r
    FROM customer GROUP BY c_nationkey""")
def regression_by_key(spark: SparkSession, sf: str) -> DataFrame:
    out = m.linregress(fx.table(spark, sf, "customer"), "c_custkey", "c_acctbal", ["c_nationkey"])
    return out.select("c_nationkey", "n", R("slope").alias("slope"), R("r").alias("r"))


_MODEL_MASKS = """
    SELECT 'bright' AS model_id, image_id, row, col, CASE WHEN red >= 128 THEN 1 ELSE 0 END AS truth,
      CASE WHEN red >= 144 THEN 1 ELSE 0 END AS pred, CASE WHEN blue >= 140 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM px
    UNION ALL SELECT 'green', image_id, row, col, CASE WHEN red >= 128 THEN 1 ELSE 0 END,
      CASE WHEN green >= 146 THEN 1 ELSE 0 END, CASE WHEN blue >= 140 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END FROM px"""

#: Masks of both models under one key, so that the object queries' steps apply: twice the image, plus one for the second model.
_CLEAN = [
    ("mm", _MODEL_MASKS),
    ("obj", "SELECT image_id * 2 + CASE WHEN model_id = 'green' THEN 1 ELSE 0 END AS image_id, row, col, pred AS mask FROM mm"),
    *_ALL_CONTOURS,
    ("gone", """
      SELECT DISTINCT i.image_id // 2 AS image_id, CASE WHEN i.image_id % 2 = 1 THEN 'green' ELSE 'bright' END AS model_id, i.row, i.col
      FROM inside i JOIN carea a USING (image_id, kind, root) WHERE contour_area < 2"""),
    ("staged", """
      SELECT 'raw' AS stage, * FROM mm
      UNION ALL SELECT 'cleaned', m.model_id, m.image_id, m.row, m.col, truth, CASE WHEN k.row IS NULL THEN pred ELSE 0 END, weight
      FROM mm m LEFT JOIN gone k ON k.model_id = m.model_id AND k.image_id = m.image_id AND k.row = m.row AND k.col = m.col"""),
    ("met", _METRICS[1].replace("SELECT image_id,", "SELECT stage, model_id, image_id,").replace(
        "FROM tp GROUP BY image_id", "FROM staged GROUP BY stage, model_id, image_id")),
]


@query(with_ctes(["px"], "SELECT stage, model_id, " + ", ".join(
    f"{r10(f'avg({c})')} AS {c}" for c in _NAMES) + " FROM met GROUP BY stage, model_id", True, _CLEAN))
def report_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Macro scores per model before and after removing small objects."""
    out = ev.report_by_model(_two_models(spark, sf), 2.0, block=BLOCK)
    return out.select("stage", "model_id", *[R10(c).alias(c) for c in _NAMES])


def _two_models(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.sized_pixels(spark, sf)
    common = ["image_id", "row", "col", "rows", "cols", (F.col("red") >= 128).cast("int").alias("truth"),
              F.when(F.col("blue") >= 140, F.lit(5.0)).otherwise(F.lit(1.0)).alias("weight")]
    return px.select(F.lit("bright").alias("model_id"), *common, (F.col("red") >= 144).cast("int").alias("pred")).unionByName(
        px.select(F.lit("green").alias("model_id"), *common, (F.col("green") >= 146).cast("int").alias("pred")))


@query(with_ctes(["px"], f"""
    SELECT model_id, CAST(sum(n_before) AS BIGINT) AS n_before, CAST(sum(n_after) AS BIGINT) AS n_after, CAST(sum(pred_px) AS BIGINT) AS pred_px,
      CAST(sum(truth_px) AS BIGINT) AS truth_px, {r6('sum(pred_px) / sum(truth_px)')} AS area_ratio,
      {r6('(sum(n_before) - sum(n_after)) / sum(n_before)')} AS decrease, {r6('sum(n_after) / (sum(n_px) * 0.04::DOUBLE) * 10000')} AS per_ha
    FROM (SELECT model_id, image_id, count(*) AS n_px, sum(truth) AS truth_px, sum(pred) AS pred_px FROM staged WHERE stage = 'cleaned' GROUP BY ALL)
    JOIN (SELECT image_id // 2 AS image_id, CASE WHEN image_id % 2 = 1 THEN 'green' ELSE 'bright' END AS model_id, count(*) AS n_before,
        count(*) FILTER (contour_area >= 2) AS n_after FROM carea GROUP BY ALL) USING (model_id, image_id)
    GROUP BY model_id""", True, _CLEAN))
def count_report_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per model before and after removing small contours, canopy against truth, trees per hectare."""
    per_image = ev.counts_by_image(_two_models(spark, sf), 2.0, block=BLOCK)
    out = ev.count_report_by_model(per_image)
    names = ["area_ratio", "decrease", "per_ha"]
    return out.select("model_id", "n_before", "n_after", "pred_px", "truth_px", *[R(c).alias(c) for c in names])
