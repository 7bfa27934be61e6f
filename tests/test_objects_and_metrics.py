import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlake.operators import metrics as m, objects as ob
from gridlake.plans import evaluation as ev


def mask_df(raster, mask):
    return raster(mask, "mask").withColumn("mask", F.col("mask").cast("int"))


def flood(mask, diagonal):
    """Brute-force labels: every component named by its first pixel."""
    h, w = mask.shape
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    name = {}
    for r in range(h):
        for c in range(w):
            if mask[r, c] and (r, c) not in name:
                stack = [(r, c)]
                name[(r, c)] = (r, c)
                while stack:
                    y, x = stack.pop()
                    for a, b in steps:
                        q = (y + a, x + b)
                        if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and q not in name:
                            name[q] = (r, c)
                            stack.append(q)
    return name


def spiral(n):
    s = np.zeros((n, n), int)
    r, c, dr, dc = 0, 0, 0, 1
    s[0, 0] = 1
    lo, turns = 0, 0
    while turns < 2:
        y, x = r + dr, c + dc
        yy, xx = r + 2 * dr, c + 2 * dc
        ahead = 0 <= y < n and 0 <= x < n and not (0 <= yy < n and 0 <= xx < n and s[yy, xx]) and not s[y, x]
        if ahead:
            r, c, turns = y, x, 0
            s[r, c] = 1
        else:
            dr, dc, turns = dc, -dr, turns + 1
    return s


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("density", [0.2, 0.45, 0.6])
def test_components_equal_flood_fill(spark, raster, diagonal, density):
    mask = (np.random.default_rng(7).random((23, 31)) < density).astype(int)
    df = mask_df(raster, mask.tolist()).where("mask = 1")
    out = ob.label_components(df, connectivity=8 if diagonal else 4, block=8)
    got = {(r["row"], r["col"]): tuple(r["component"]) for r in out.collect()}
    assert got == flood(mask, diagonal)


def test_one_component_that_winds_through_all_blocks(spark, raster):
    mask = spiral(24)
    out = ob.label_components(mask_df(raster, mask.tolist()).where("mask = 1"), connectivity=4, block=4)
    assert out.select("component").distinct().count() == len(set(flood(mask, False).values())) == 1
    assert out.count() == mask.sum()


def test_connect_long_path_and_hub(spark):
    path = spark.range(400).select(F.lit(0).alias("k"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    hub = spark.range(1, 400).select(F.lit(1).alias("k"), F.lit(1000).cast("long").alias("u"), (F.col("id") + 1000).alias("v"))
    out = ob.connect(path.unionByName(hub), ["k"])
    assert {(r["k"], r["root"]) for r in out.select("k", "root").distinct().collect()} == {(0, 0), (1, 1000)}
    assert out.count() == 400 + 399


def test_holes_and_contours(spark, raster):
    mask = [[1, 1, 1, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 0, 0], [0, 0, 0, 0, 0], [1, 1, 0, 0, 0]]
    df = mask_df(raster, mask)
    assert ob.count_holes(df, "mask", block=2).first()["n_holes"] == 1
    assert ev.contour_counts(df, "mask", ["image_id"], 2).first()["n_contours"] == 3 + 1


def test_areas_through_pixel_centres(spark, raster):
    mask = np.zeros((8, 8), int)
    mask[0, 0] = 1            # one pixel: 0
    mask[2:5, 0:4] = 1        # 3×4: 2·3 = 6
    mask[7, 0:5] = 1          # a line: 0
    out = ob.object_area(ob.label_components(mask_df(raster, mask.tolist()).where("mask = 1"), block=4))
    got = {tuple(r["component"]): (r["px_area"], r["contour_area"]) for r in out.collect()}
    assert got == {(0, 0): (1, 0), (2, 0): (12, 6), (7, 0): (5, 0)}
    kept, counts = ob.remove_small(mask_df(raster, mask.tolist()), "mask", 2, block=4)
    assert kept.count() == 12 and tuple(counts.first())[1:] == (3, 1)
    drop = ob.count_drop(counts).first()
    assert drop["decrease"] == pytest.approx(2 / 3)


def test_areas_with_holes(spark, raster):
    ring = np.zeros((12, 12), int)
    ring[1:11, 1:11] = 1
    ring[2:10, 2:10] = 0      # the rim of a 10×10 square: 9·9, its hole as drawn through the rim
    ring[4:7, 4:7] = 1        # an object in the hole, with a hole of one pixel
    ring[5, 5] = 0
    df = mask_df(raster, ring.tolist())
    areas = ob.contour_measures(ob.contour_tree(df, "mask", block=4)).collect()
    assert sorted((r["px_area"], r["contour_area"]) for r in areas) == [(5, 2.0), (9, 4.0), (96, 79.0), (100, 81.0)]
    kept, counts = ob.remove_small(df, "mask", 3, block=4)
    assert tuple(counts.first())[1:] == (4, 3) and kept.count() == 36 + 8 - 4
    kept, counts = ob.remove_small(df, "mask", 10, block=4)
    assert tuple(counts.first())[1:] == (4, 2) and kept.count() == 36
    kept, counts = ob.remove_small(df, "mask", 80, block=4)
    assert tuple(counts.first())[1:] == (4, 1) and kept.count() == 4
    assert ob.remove_small(df, "mask", 100, block=4)[0].count() == 0


def pairs(spark, rows):
    return spark.createDataFrame([(0, float(t), float(p), float(w)) for t, p, w in rows], "image_id int, truth double, pred double, weight double")


def test_dice_of_two_empty_masks_is_one(spark):
    r = m.segmentation_metrics(pairs(spark, [(0, 0, 1)] * 4), ["image_id"]).first()
    assert r["dice"] == 1 and math.isnan(r["sensitivity"]) and r["specificity"] == 1 and r["mean_iou"] == 1 and r["accuracy"] == 1


def test_half_even_rounding(spark):
    r = m.confusion(pairs(spark, [(1, 0.5, 1), (1, 0.51, 1), (0, 0.5, 1), (0, 1.0, 1)]), ["image_id"]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 0, 0)


def test_metrics_by_hand(spark):
    rows = [(1, 1, 5)] * 3 + [(0, 1, 1)] * 2 + [(1, 0, 1)] * 1 + [(0, 0, 1)] * 4
    r = m.segmentation_metrics(pairs(spark, rows), ["image_id"]).first()
    assert r["dice"] == pytest.approx(6 / 9) and r["sensitivity"] == 3 / 4 and r["specificity"] == 4 / 6
    assert r["mean_iou"] == pytest.approx((3 / 6 + 4 / 7) / 2)
    assert r["loss"] == pytest.approx(1 - 15 / (15 + 0.6 * 2 + 0.4 * 1 + 1e-5))
    c = m.confusion(pairs(spark, rows), ["image_id"]).first()
    assert c["tp"] + c["fp"] + c["tn"] + c["fn"] == 10


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (4.0, 4.0), (5.0, 5.0)], "x double, y double")
    r = m.linregress(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r"]) == pytest.approx((0.6, 2.2, 0.7745966692414834))
    assert (r["stderr"], r["p"]) == pytest.approx((0.28284271247461906, 0.12402706265755441))


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 1.0), (2.0, 10, 0.07338803477074037), (12.706204736432095, 1, 0.05), (1.959963984540054, 1e7, 0.05)])
def test_student_tail(spark, t, df, p):
    got = spark.range(1).select(m.student_two_sided(F.lit(t), F.lit(df)).alias("p"), m.student_two_sided(F.lit(-t), F.lit(df)).alias("q")).first()
    assert got["p"] == got["q"] == pytest.approx(p, rel=1e-6)


def test_student_tail_at_its_ends(spark):
    of = lambda t, n: spark.range(1).select(m.student_two_sided(F.lit(t), F.lit(n)).alias("p")).first()["p"]
    assert of(math.inf, 5) == 0 and of(1.0, 0) is None and math.isnan(of(math.nan, 5)) and of(1e-200, 3) == 1
    # closed forms: one degree of freedom is the Cauchy distribution, two have p = 1 - t / sqrt(2 + t²)
    for t in (0.01, 0.5, 3.0, 50.0):
        assert of(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-12)
        assert of(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


def test_count_errors(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 17.0)], "t double, p double")
    r = m.count_errors(df, "t", "p").first()
    assert (r["mae"], r["rmae"], r["relative_total_error"]) == pytest.approx((2.5, 2.5 / 15, 100 / 30))


def test_per_hectare(spark):
    r = spark.createDataFrame([(50.0, 2500)], "n double, px int").select(ob.per_hectare("n", "px").alias("v")).first()
    assert r["v"] == pytest.approx(50 / (2500 * 0.04) * 10000)


def test_weighted_mae_picks_per_pixel(spark):
    df = spark.createDataFrame([(5.0, 6.0), (10.0, 13.0)], "t double, p double")
    assert sorted(r["loss"] for r in m.weighted_mae(df, "t", "p").collect()) == [2.0, 10.0]


def test_ssim_of_equal_images_is_one(raster):
    img = raster([[((r * 3 + c * 5) % 13) / 13 for c in range(14)] for r in range(13)])
    assert m.ssim(img.withColumn("w", F.col("v")), "v", "w").first()["ssim"] == pytest.approx(1)
    assert m.mse_ssim(img.withColumn("w", F.col("v")), "v", "w").first()["mse_ssim"] == pytest.approx(0)


def test_report_by_model_cleans(spark, raster):
    truth = np.zeros((8, 8), int)
    truth[1:5, 1:5] = 1
    pred = truth.copy()
    pred[7, 7] = 1
    df = raster(truth.tolist(), "truth").join(raster(pred.tolist(), "pred").drop("rows", "cols"), ["image_id", "row", "col"])
    df = df.withColumns({"model_id": F.lit("m"), "weight": F.lit(1.0), "truth": F.col("truth").cast("int"), "pred": F.col("pred").cast("int")})
    out = {r["stage"]: r for r in ev.report_by_model(df, 2.0, block=4).collect()}
    assert out["raw"]["dice"] == pytest.approx(32 / 33) and out["cleaned"]["dice"] == 1
    counts = ev.counts_by_image(df, 2.0, block=4)
    assert tuple(counts.first())[2:] == (1, 2, 1, 16, 16, 64)
    total = ev.count_report_by_model(counts).first()
    assert (total["decrease"], total["area_ratio"]) == (0.5, 1.0) and total["per_ha"] == pytest.approx(10000 / (64 * 0.04))
    assert ev.count_regression_by_model(counts).count() == 1


def test_one_task_labels_neighbouring_blocks_and_copies_once():
    rng = np.random.default_rng(4)
    mask = rng.random((24, 40)) < 0.55
    row, col = (x.astype(np.int32) - 16 for x in np.nonzero(mask))  # also left of and above the origin
    order = rng.permutation(np.append(np.arange(len(row)), [0, 5, 5]))
    # one span of 8 x 8 blocks of 4 pixels
    near = (row[order] >= -16) & (row[order] < 16) & (col[order] >= 0) & (col[order] < 32)
    table = pa.table({"image_id": pa.array([None] * int(near.sum()), pa.int64()), "row": row[order][near], "col": col[order][near]})
    out = ob._label_blocks(4, False)(table)
    got = {(r["row"], r["col"]): r["local"] for r in out.to_pylist()}
    assert out.num_rows == len(got) == len({(r["row"], r["col"]) for r in table.to_pylist()})
    for (r, c), local in got.items():
        seen, todo = {(r, c)}, [(r, c)]
        while todo:
            y, x = todo.pop()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in got and p not in seen and (p[0] // 4, p[1] // 4) == (r // 4, c // 4):
                    seen.add(p)
                    todo.append(p)
        assert local == min(y % 4 * 4 + x % 4 for y, x in seen)


def test_holes_are_found_in_blocks_of_many_spans(spark, raster):
    img = np.ones((40, 44))
    img[1:39, 1:43] = 0  # a hole that reaches through all spans of blocks of 2
    img[20, 0] = 0       # at the edge, and beside the hole
    img[5:8, 5:8] = 1
    img[6, 6] = 0
    holes = ob.label_holes(raster(img.tolist(), "m"), "m", block=2)
    assert sorted(holes.columns) == ["col", "component", "image_id", "row"]
    assert [(r["component"]["row"], r["component"]["col"]) for r in holes.collect()] == [(6, 6)]
