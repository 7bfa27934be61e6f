"""Queries over splits, sampling, augmentation and training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sampling as sp
from ..operators.resample import downsample
from ..plans.training import batch_report, draw_patches, epoch_steps, training_batches, two_resolution_batches as two_resolutions
from . import fixtures as fx
from .fixtures import SIDE, r6 as R, with_ctes
from .registry import query, r6
from .tiles import _frames, _hash_sql

P = 16  # patch side of the augmentation queries


def _md5(seed: str, key: str) -> str:
    return f"md5('{seed}' || '-' || CAST({key} AS VARCHAR))"


_RANKED = ("ranked", f"""SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY {_md5('1117', 'o_orderkey')}, o_orderkey) - 1 AS pos,
    count(*) OVER () AS n FROM orders""")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"))


@query(f"""WITH ranked AS ({_RANKED[1]}) SELECT frame_id, CAST(CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1)
    ELSE (n % 10) + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS fold FROM ranked""")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Ten folds of the orders, taken as frames, in a hashed order."""
    return sp.kfold(_orders(spark, sf))


@query(f"""WITH ranked AS ({_RANKED[1]}), f AS (SELECT frame_id, CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1)
    ELSE (n % 10) + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS fold FROM ranked)
    SELECT CAST(s.range AS INTEGER) AS split, CASE WHEN fold = s.range THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM f, range(10) s GROUP BY ALL""")
def kfold_roles(spark: SparkSession, sf: str) -> DataFrame:
    return sp.kfold_roles(sp.kfold(_orders(spark, sf))).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH ranked AS ({_RANKED[1]}) SELECT frame_id, CASE WHEN pos < ceil(n * 0.2) THEN 'val' ELSE 'train' END AS role FROM ranked""")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return sp.train_val_split(_orders(spark, sf))


@query("""SELECT origin, copy, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM (
    SELECT 'local' AS origin, CAST(t.range AS INTEGER) AS copy, s_suppkey AS k FROM supplier, range(4) t
    UNION ALL SELECT 'base', NULL, c_custkey FROM customer) GROUP BY ALL""")
def oversample_union(spark: SparkSession, sf: str) -> DataFrame:
    """Local frames four times, then the pretraining frames."""
    local = sp.oversample(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), 4)
    both = sp.union_sources(local, fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))
    return both.groupBy("origin", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


# --- augmentation on 16×16 patches that tile the images ---------------------------------------------------------

_PATCH = ("pa", f"SELECT image_id, row // {P} AS pr, col // {P} AS pc, row % {P} AS row, col % {P} AS col, red, green FROM px")
PATCH_KEYS = ["image_id", "pr", "pc"]


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf)
    return px.select(
        "image_id", F.floor(F.col("row") / P).cast("int").alias("pr"), F.floor(F.col("col") / P).cast("int").alias("pc"),
        F.pmod("row", F.lit(P)).alias("row"), F.pmod("col", F.lit(P)).alias("col"), "red", "green")


def _draw(name: str) -> str:
    return f"({_hash_sql(name, 'image_id', 'pr', 'pc')} / 4294967296.0::DOUBLE)"


@query(with_ctes(["px"], f"""
    SELECT image_id, pr, pc, CASE WHEN {_draw('9ud')} < 0.5 THEN {P - 1} - row ELSE row END AS row,
      CASE WHEN {_draw('9lr')} < 0.5 THEN {P - 1} - col ELSE col END AS col, red FROM pa""", extra=[_PATCH]))
def flips(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.flip_ud(sp.flip_lr(_patches(spark, sf), P, 9, PATCH_KEYS), P, 9, PATCH_KEYS)
    return out.select(*PATCH_KEYS, "row", "col", "red")


def _gather_sql(source: str, chosen: str, inside: str = "TRUE") -> str:
    """Bilinear read at (sr, sc) of the chosen patches, the others as they are."""
    return f"""
    SELECT image_id, pr, pc, row, col, {r6('red')} AS red FROM pa WHERE NOT ({chosen})
    UNION ALL
    SELECT t.image_id, t.pr, t.pc, t.row, t.col, {r6(f'sum(CASE WHEN {inside} THEN p.red * t.w ELSE 0 END)')} AS red FROM (
      SELECT s.*, greatest(0, least({P - 1}, floor(sr) + a.range)) AS qr, greatest(0, least({P - 1}, floor(sc) + b.range)) AS qc,
        (CASE WHEN a.range = 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END) * (CASE WHEN b.range = 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END) AS w
      FROM ({source}) s, range(2) a, range(2) b) t
    JOIN pa p ON p.image_id = t.image_id AND p.pr = t.pr AND p.pc = t.pc AND p.row = t.qr AND p.col = t.qc
    GROUP BY 1, 2, 3, 4, 5"""


_CROP = ("cr", f"""SELECT *, floor({_draw('9top')} * 1.6::DOUBLE) AS t0, floor({_draw('9bottom')} * 1.6::DOUBLE) AS b0,
    floor({_draw('9left')} * 1.6::DOUBLE) AS l0, floor({_draw('9right')} * 1.6::DOUBLE) AS r0 FROM pa WHERE {_draw('9crop')} < 0.5""")


@query(with_ctes(["px"], _gather_sql(f"""
    SELECT image_id, pr, pc, row, col,
      t0 + greatest(0, least((row + 0.5::DOUBLE) * ({P} - t0 - b0) / {P} - 0.5::DOUBLE, {P} - t0 - b0 - 1)) AS sr,
      l0 + greatest(0, least((col + 0.5::DOUBLE) * ({P} - l0 - r0) / {P} - 0.5::DOUBLE, {P} - l0 - r0 - 1)) AS sc FROM cr""",
    f"{_draw('9crop')} < 0.5"), extra=[_PATCH, _CROP]))
def random_crop_resize(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.random_crop_resize(_patches(spark, sf), P, 9, PATCH_KEYS, ["red"])
    return out.select(*PATCH_KEYS, "row", "col", R("red").alias("red"))


_AFFINE = ("af", f"""
    SELECT *, col - 7.5::DOUBLE - tx AS x, row - 7.5::DOUBLE - ty AS y, sx * cos(ro) AS a, -sy * sin(ro + sh) AS b, sx * sin(ro) AS c, sy * cos(ro + sh) AS d
    FROM (SELECT *, 0.8::DOUBLE + {_draw('9sx')} * 0.4::DOUBLE AS sx, 0.8::DOUBLE + {_draw('9sy')} * 0.4::DOUBLE AS sy,
      (-0.2::DOUBLE + {_draw('9tx')} * 0.4::DOUBLE) * {P} AS tx, (-0.2::DOUBLE + {_draw('9ty')} * 0.4::DOUBLE) * {P} AS ty,
      radians(-45 + {_draw('9rot')} * 90) AS ro, radians(-16 + {_draw('9shear')} * 32) AS sh FROM pa WHERE {_draw('9affine')} < 0.5)""")


@query(with_ctes(["px"], _gather_sql("""
    SELECT image_id, pr, pc, row, col, (a * y - c * x) / (a * d - b * c) + 7.5::DOUBLE AS sr, (d * x - b * y) / (a * d - b * c) + 7.5::DOUBLE AS sc FROM af""",
    f"{_draw('9affine')} < 0.5", f"sr BETWEEN -0.5 AND {P - 0.5} AND sc BETWEEN -0.5 AND {P - 0.5}"), extra=[_PATCH, _AFFINE]))
def affine(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.affine(_patches(spark, sf), P, 9, PATCH_KEYS, ["red"])
    return out.select(*PATCH_KEYS, "row", "col", R("red").alias("red"))


@query(with_ctes(["px"], f"""
    SELECT image_id, pr, pc, row, col, CASE WHEN {_draw('9mul')} < 0.3::DOUBLE THEN {r6(f"red * (0.85::DOUBLE + {_draw('9red')} * (1.15::DOUBLE - 0.85::DOUBLE))")} ELSE red END AS red,
      CASE WHEN {_draw('9mul')} < 0.3::DOUBLE THEN {r6(f"green * (0.85::DOUBLE + {_draw('9green')} * (1.15::DOUBLE - 0.85::DOUBLE))")} ELSE green END AS green
    FROM pa""", extra=[_PATCH]))
def channel_multiply(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.channel_multiply(_patches(spark, sf), 9, PATCH_KEYS, ["red", "green"])
    return out.select(*PATCH_KEYS, "row", "col", R("red").alias("red"), R("green").alias("green"))


@query(with_ctes(["px"], f"""
    SELECT image_id, pr, pc, row, col, red FROM pa WHERE NOT ({_draw('9blur')} < 0.3::DOUBLE)
    UNION ALL
    SELECT o.image_id, o.pr, o.pc, o.row, o.col, {r6('sum(i.red * a.w * b.w)')} AS red
    FROM (SELECT * FROM pa WHERE {_draw('9blur')} < 0.3::DOUBLE) o CROSS JOIN g a CROSS JOIN g b
    JOIN pa i ON i.image_id = o.image_id AND i.pr = o.pr AND i.pc = o.pc AND i.row = greatest(0, least({P - 1}, o.row + a.d))
      AND i.col = greatest(0, least({P - 1}, o.col + b.d)) GROUP BY 1, 2, 3, 4, 5""",
                 extra=[_PATCH, ("g", """SELECT CAST(range AS INTEGER) - 2 AS d, exp(-(range - 2) * (range - 2) / 0.18::DOUBLE)
                   / sum(exp(-(range - 2) * (range - 2) / 0.18::DOUBLE)) OVER () AS w FROM range(5)""")]))
def blur(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.blur(_patches(spark, sf).select(*PATCH_KEYS, "row", "col", "red"), P, 9, PATCH_KEYS, ["red"])
    return out.withColumn("red", R("red"))


# --- batches ---------------------------------------------------------------------------------------------------------

_BATCH, _PER_FRAME = 4, 8  # slots of a step; patches that an epoch draws for each frame

_DRAWN = ("dr", f"""
    SELECT step, slot, frame_id, {_hash_sql('21r', '4', 'step', 'slot')} % {SIDE - P} AS patch_row,
      {_hash_sql('21c', '4', 'step', 'slot')} % {SIDE - P} AS patch_col
    FROM (SELECT CAST(i // {_BATCH} AS INTEGER) AS step, CAST(i % {_BATCH} AS INTEGER) AS slot, {_hash_sql('21f', '4', f'i // {_BATCH}', f'i % {_BATCH}')} % n AS frame_idx
          FROM (SELECT n, unnest(range(greatest(1, (n * {_PER_FRAME} + {_BATCH - 1}) // {_BATCH}) * {_BATCH})) AS i FROM (SELECT count(*) AS n FROM images)))
    JOIN (SELECT image_id AS frame_id, row_number() OVER (ORDER BY image_id) - 1 AS frame_idx FROM images) USING (frame_idx)""")

_CUT = ("cut", f"""
    SELECT step, slot, row, col, CASE WHEN {_hash_sql('21-4-n', 'step', 'slot')} / 4294967296.0::DOUBLE <= 0.4::DOUBLE
        THEN (red - avg(red) OVER w) / (stddev_pop(red) OVER w + 1e-8) ELSE red END AS red, ann, bnd, density
    FROM (SELECT step, slot, px.row - patch_row AS row, px.col - patch_col AS col, red, CASE WHEN red >= 144 THEN 1 ELSE 0 END AS ann,
            CASE WHEN blue >= 150 THEN 1 ELSE 0 END AS bnd, green / 4096 AS density
          FROM dr JOIN px ON px.image_id = frame_id AND px.row >= patch_row AND px.row < patch_row + {P}
            AND px.col >= patch_col AND px.col < patch_col + {P})
    WINDOW w AS (PARTITION BY step, slot)""")


def _steps(spark: SparkSession, sf: str) -> int:
    return epoch_steps(_frames(spark, sf).count(), _BATCH, _PER_FRAME)


@query(with_ctes(["images"], "SELECT step, slot, frame_id, patch_row, patch_col FROM dr", extra=[_DRAWN]))
def draw_training_patches(spark: SparkSession, sf: str) -> DataFrame:
    """An epoch with as many steps as the frames ask for."""
    return draw_patches(_frames(spark, sf), 4, _steps(spark, sf), _BATCH, P, 21).drop("rows", "cols")


@query(with_ctes(["images", "px"], f"""
    SELECT step, slot, row, col, {r6('red')} AS red, ann, CASE WHEN bnd = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, density FROM cut""",
                 extra=[_DRAWN, _CUT]))
def training_batches_plain(spark: SparkSession, sf: str) -> DataFrame:
    """An epoch without augmentation: draws, cuts, normalisation by chance, label targets."""
    out = training_batches(_frames(spark, sf), _labelled(spark, sf), 4, _steps(spark, sf), _BATCH, P, ["red"], 21, augment=False)
    return out.withColumn("red", R("red"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pixels(spark, sf).select(
        F.col("image_id").alias("frame_id"), "row", "col", "red", (F.col("red") >= 144).cast("int").alias("annotation"),
        (F.col("blue") >= 150).cast("int").alias("boundary"), (F.col("green") / 4096).alias("density"))


def _of_patch(name: str) -> str:
    return f"({_hash_sql(f'21-4-a{name}', 'step', 'slot')} / 4294967296.0::DOUBLE)"


#: The patches flipped, and where a cropped and stretched one reads.
_FLIPPED = ("fl", f"""
    SELECT step, slot, CASE WHEN {_of_patch('ud')} < 0.5 THEN {P - 1} - row ELSE row END AS row,
      CASE WHEN {_of_patch('lr')} < 0.5 THEN {P - 1} - col ELSE col END AS col, red, ann::DOUBLE AS ann, bnd::DOUBLE AS bnd, density FROM cut""")


def _cropped(name: str, flipped: str, side: int, values: list[str]) -> list[tuple[str, str]]:
    """The flipped patches of ``side``, those chosen cropped by margins in full pixels and stretched back."""
    part = P // side
    read = f"""
    SELECT step, slot, row, col, t0 + greatest(0, least((row + 0.5::DOUBLE) * ({side} - t0 - b0) / {side} - 0.5::DOUBLE, {side} - t0 - b0 - 1)) AS sr,
      l0 + greatest(0, least((col + 0.5::DOUBLE) * ({side} - l0 - r0) / {side} - 0.5::DOUBLE, {side} - l0 - r0 - 1)) AS sc
    FROM (SELECT step, slot, floor({_of_patch('top')} * 1.6::DOUBLE) / {part} AS t0, floor({_of_patch('bottom')} * 1.6::DOUBLE) / {part} AS b0,
            floor({_of_patch('left')} * 1.6::DOUBLE) / {part} AS l0, floor({_of_patch('right')} * 1.6::DOUBLE) / {part} AS r0 FROM dr WHERE {_of_patch('crop')} < 0.5),
      (SELECT range AS row FROM range({side})), (SELECT range AS col FROM range({side}))"""
    out = f"""
    SELECT step, slot, row, col, {', '.join(values)} FROM {flipped} WHERE NOT ({_of_patch('crop')} < 0.5)
    UNION ALL
    SELECT t.step, t.slot, t.row, t.col, {', '.join(f'sum(p.{v} * w)' for v in values)} FROM (
      SELECT s.*, greatest(0, least({side - 1}, floor(sr) + a.range)) AS qr, greatest(0, least({side - 1}, floor(sc) + b.range)) AS qc,
        (CASE WHEN a.range = 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END) * (CASE WHEN b.range = 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END) AS w
      FROM {name}_read s, range(2) a, range(2) b) t
    JOIN {flipped} p ON p.step = t.step AND p.slot = t.slot AND p.row = t.qr AND p.col = t.qc GROUP BY 1, 2, 3, 4"""
    return [(f"{name}_read", read), (name, out)]


_AUGMENTED = [_DRAWN, _CUT, _FLIPPED, *_cropped("au", "fl", P, ["red", "ann", "bnd", "density"])]
_SUMS = f"""
    SELECT step, slot, count(*) AS n_px, {r6('sum(red)')} AS red, {r6(f'sum(red * (row * {P} + col)) / {P * P}')} AS red_at, {r6('sum(density)')} AS density,
      CAST(sum(CASE WHEN ann >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS ann, CAST(sum(CASE WHEN ann >= 0.5 THEN row * {P} + col ELSE 0 END) AS BIGINT) AS ann_at,
      sum(CASE WHEN bnd >= 0.5 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM au GROUP BY step, slot"""


@query(with_ctes(["images", "px"], _SUMS, extra=_AUGMENTED))
def training_batches_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """A whole epoch with flips and crops: sums of inputs and targets of each patch, and the same weighed by position."""
    out = training_batches(_frames(spark, sf), _labelled(spark, sf), 4, _steps(spark, sf), _BATCH, P, ["red"], 21)
    at = (F.col("row") * P + F.col("col")).cast("long")
    return out.groupBy("step", "slot").agg(
        F.count(F.lit(1)).alias("n_px"), R(F.sum("red")).alias("red"), R(F.sum(F.col("red") * at) / (P * P)).alias("red_at"),
        R(F.sum("density")).alias("density"), F.sum("ann").cast("long").alias("ann"), F.sum(F.col("ann") * at).cast("long").alias("ann_at"),
        F.sum("weight").alias("weight"))


@query(with_ctes(["images", "px"], """
    SELECT step, CASE WHEN bnd = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) AS n_px FROM cut GROUP BY ALL""", extra=[_DRAWN, _CUT]))
def distinct_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The loss weights of each step."""
    out = training_batches(_frames(spark, sf), _labelled(spark, sf), 4, _steps(spark, sf), _BATCH, P, ["red"], 21, augment=False)
    return batch_report(out, ["red"])[1]


_H = P // 2
_HALF = [
    ("hpx", "SELECT image_id, row // 2 AS row, col // 2 AS col, avg(infrared) / 8 AS height FROM px GROUP BY 1, 2, 3"),
    ("hcut", f"""
    SELECT step, slot, row, col, CASE WHEN {_hash_sql('21-4-n', 'step', 'slot')} / 4294967296.0::DOUBLE <= 0.4::DOUBLE
        THEN (height - avg(height) OVER w) / (stddev_pop(height) OVER w + 1e-8) ELSE height END AS height
    FROM (SELECT step, slot, h.row - patch_row // 2 AS row, h.col - patch_col // 2 AS col, height FROM dr JOIN hpx h ON h.image_id = frame_id
            AND h.row >= patch_row // 2 AND h.row < patch_row // 2 + {_H} AND h.col >= patch_col // 2 AND h.col < patch_col // 2 + {_H})
    WINDOW w AS (PARTITION BY step, slot)"""),
    ("hfl", f"""
    SELECT step, slot, CASE WHEN {_of_patch('ud')} < 0.5 THEN {_H - 1} - row ELSE row END AS row,
      CASE WHEN {_of_patch('lr')} < 0.5 THEN {_H - 1} - col ELSE col END AS col, height FROM hcut"""),
    *_cropped("hau", "hfl", _H, ["height"])]


@query(with_ctes(["images", "px"], f"""
    SELECT * FROM ({_SUMS}) JOIN (SELECT step, slot, {r6('sum(height)')} AS height, {r6(f'sum(height * (row * {_H} + col)) / {_H * _H}')} AS height_at
    FROM hau GROUP BY step, slot) USING (step, slot)""", extra=[*_AUGMENTED, *_HALF]))
def two_resolution_batches(spark: SparkSession, sf: str) -> DataFrame:
    """An epoch of patches with a second input at half the resolution, the same flips and crops in both: sums of inputs and targets."""
    half = downsample(fx.pixels(spark, sf), 2, ["infrared"]).select(F.col("image_id").alias("frame_id"), "row", "col", (F.col("infrared") / 8).alias("height"))
    out = two_resolutions(
        _frames(spark, sf), _labelled(spark, sf), half, 4, _steps(spark, sf), _BATCH, P, ["red"], ["height"], 21)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    placed = lambda v: total(F.transform(v, lambda x, i: x * i))
    return out.select(
        "step", "slot", F.size(F.filter("there", lambda t: t)).cast("long").alias("n_px"), R(total("red")).alias("red"), R(placed("red") / (P * P)).alias("red_at"),
        R(total("density")).alias("density"), total("ann").cast("long").alias("ann"), placed("ann").cast("long").alias("ann_at"),
        total("weight").alias("weight"), R(total("height")).alias("height"), R(placed("height") / (_H * _H)).alias("height_at"))
