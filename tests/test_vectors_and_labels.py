import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry as g
from gridlake.functions.numbering import hashed_rank, ordered_number
from gridlake.operators import labels as lb, resample as rs, spatial_join as sj

RING = "array<struct<x:double,y:double>>"
TRIANGLE = [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)]
ELL = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]


def rings(spark, *named):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r] if r else None) for i, r in named], f"id long, ring {RING}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_area_and_centroid(spark):
    df = rings(spark, (1, TRIANGLE), (2, ELL), (3, ELL[::-1] + [ELL[-1]]), (4, [(1.0, 1.0), (3.0, 3.0)]))
    out = {r["id"]: r for r in df.select("id", g.area("ring").alias("a"), g.centroid("ring").alias("c")).collect()}
    assert out[1]["a"] == 6 and (out[1]["c"]["x"], out[1]["c"]["y"]) == pytest.approx((4 / 3, 1))
    assert out[2]["a"] == 12 and (out[2]["c"]["x"], out[2]["c"]["y"]) == pytest.approx((5 / 3, 5 / 3))
    assert out[3]["a"] == 12 and out[3]["c"]["x"] == pytest.approx(5 / 3)
    assert (out[4]["c"]["x"], out[4]["c"]["y"]) == (2, 2)


def test_scaling_is_about_the_box_centre(spark):
    df = rings(spark, (1, TRIANGLE)).select(g.scale_ring("ring", 1.5).alias("r"))
    assert [(p["x"], p["y"]) for p in df.first()["r"]] == [(-1, -0.75), (5, -0.75), (-1, 3.75)]


@pytest.mark.parametrize("other,want", [
    (box(3, 3, 5, 5), False),          # in the notch of the L
    (box(1, 1, 1.5, 1.5), True),       # inside
    (box(-9, -9, 9, 9), True),         # around
    (box(4, 0, 6, 1), True),           # shared edge
    (box(1, -1, 1.5, 9), True),        # across
    (box(4.1, 0, 6, 1), False),
])
def test_intersects(spark, other, want):
    a, b = rings(spark, (1, ELL)), rings(spark, (1, other)).withColumnRenamed("ring", "o")
    assert a.join(b, "id").select(g.intersects("ring", "o").alias("v")).first()["v"] is want


def test_first_area_wins_and_null_rings_are_reported(spark):
    crowns = rings(spark, (1, box(0, 0, 2, 2)), (2, box(9, 9, 10, 10)), (3, None), (4, box(50, 50, 51, 51)))
    areas = rings(spark, (7, box(1, 1, 20, 20)), (5, box(2, 2, 9.5, 9.5)))
    got = {r["polygon_id"]: r["area_id"] for r in sj.assign_first_area(crowns, areas, 4.0).collect()}
    assert got == {1: 5, 2: 5}
    assert [r["id"] for r in sj.null_geometries(crowns).collect()] == [3]


@pytest.mark.parametrize("salt", [1, 5])
def test_one_crowded_cell(spark, salt):
    """All crowns in one cell, some of them identical."""
    many = [(i, box(i % 7, i % 5, i % 7 + 1, i % 5 + 1)) for i in range(300)]
    areas = [(0, box(0, 0, 3, 3)), (1, box(2, 2, 9, 9))]
    got = {r["polygon_id"]: r["area_id"] for r in sj.assign_first_area(
        rings(spark, *many), rings(spark, *areas), 100.0, salt=salt).collect()}
    meets = lambda a, b: a[0][0] <= b[2][0] and b[0][0] <= a[2][0] and a[0][1] <= b[2][1] and b[0][1] <= a[2][1]
    want = {i: min(k for k, b in areas if meets(a, b)) for i, a in many if any(meets(a, b) for _, b in areas)}
    assert got == want


def test_spatial_joins_have_no_nested_loop(spark):
    crowns, areas = rings(spark, (1, ELL)), rings(spark, (1, ELL))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sj.assign_first_area(crowns, areas, 4.0)._jdf.queryExecution().executedPlan().toString()
        pairs = sj.overlapping_pairs(crowns.withColumn("area_id", F.lit(1)), 4.0)
        plan += pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_pairs_are_ordered_and_within_an_area(spark):
    p = rings(spark, (1, box(0, 0, 2, 2)), (2, box(2.4, 0, 4, 2)), (3, box(0, 0, 1, 1)), (4, box(9, 9, 10, 10)))
    p = p.withColumn("area_id", F.when(F.col("id") == 3, 2).otherwise(1))
    got = {(r["i"], r["j"]) for r in sj.overlapping_pairs(p, 2.0, k=1.5).collect()}
    assert got == {(1, 2), (2, 1)}


def test_numbers_equal_a_single_window(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("k"))
    assert all(r["k"] == r["n"] for r in ordered_number(df, ["k"], "n").collect())
    ranks = [r["rank"] for r in hashed_rank(df, 1, ["k"]).orderBy("rank").collect()]
    assert ranks == list(range(1, 1001))


def grid(spark, rings_in, rows=8, cols=8):
    return rings(spark, *rings_in).withColumns({"frame_id": F.lit(0), "rows": F.lit(rows), "cols": F.lit(cols)})


def test_outline_keeps_touching_crowns_apart(spark, dense):
    polys = grid(spark, [(1, box(0, 0, 4, 4)), (2, box(4, 0, 7, 4))], 5, 8)
    m = dense(lb.rasterize(polys, ["frame_id"], "id", 1, 0), "value", 5, 8, 0)
    assert m == [[0] * 8] + [[0, 1, 1, 1, 0, 1, 1, 0]] * 3 + [[0] * 8]
    m = dense(lb.rasterize(polys, ["frame_id"], "id", 1, 1), "value", 5, 8, 0)
    assert m == [[1] * 8] * 5


def test_last_polygon_wins_and_frames_clip(spark, dense):
    polys = grid(spark, [(1, box(-3, -3, 20, 20)), (2, box(2, 2, 5, 5))])
    m = np.array(dense(lb.rasterize(polys, ["frame_id"], "id", 1, 0), "value", 8, 8, -1))
    assert m.min() == 0 and m.sum() == 64 - 16 + 4 and m[2, 2] == 0 and m[3, 3] == 1


def test_slanted_and_notched_polygons(spark, dense):
    m = np.array(dense(lb.rasterize(grid(spark, [(1, [(0, 0), (7, 0), (0, 7)])]), ["frame_id"], "id", 1, 1), "value", 8, 8, 0))
    assert all(m[r, c] == (1 if r + c <= 7 else 0) for r in range(8) for c in range(8))
    ell = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
    m = np.array(dense(lb.rasterize(grid(spark, [(1, [(float(x), float(y)) for x, y in ell])]), ["frame_id"], "id", 1, 1), "value", 8, 8, 0))
    assert m[5, 5] == 0 and m[1, 5] == 1 and m[5, 1] == 1 and m.sum() == 7 * 3 + 4 * 3


def test_gaps_lie_between_close_crowns(spark):
    polys = grid(spark, [(1, box(1, 1, 3, 5)), (2, box(4, 1, 6, 5)), (3, box(1, 6.9, 2, 7.9))])
    got = {(r["row"], r["col"]) for r in lb.boundary_gaps(polys, ["frame_id"]).collect()}
    # scaled: x 0.5–3.5 and 3.5–6.5 only touch, so no spot is in both
    assert got == set()
    close = grid(spark, [(1, box(1, 1, 3.8, 5)), (2, box(4.2, 1, 7, 5))])
    got = {(r["row"], r["col"]) for r in lb.boundary_gaps(close, ["frame_id"]).collect()}
    assert {(r, 3) for r in range(1, 5)} | {(r, 4) for r in range(1, 5)} >= {x for x in got if 1 <= x[0] < 5} and {r for r, _ in got} >= {1, 2, 3, 4}, "a strip of 0.4 pixels"
    wide = {(r["row"], r["col"]) for r in lb.boundary_gaps(polys, ["frame_id"], k=2.0).collect()}
    assert wide and all(c in (3, 0, 1, 2, 4, 5) for _, c in wide) and not any(1 <= r < 5 and 1 <= c < 3 for r, c in wide)


def points(spark, pts, rows, cols):
    return spark.createDataFrame([(0, r, c, rows, cols) for r, c in pts], "frame_id int, row int, col int, rows int, cols int")


def test_density_is_shifted_by_one_and_loses_mass_at_edges(spark, dense):
    d = np.array(dense(lb.density_fixed(points(spark, [(20, 20)], 50, 50), ["frame_id"]), "density", 50, 50))
    assert d.sum() == pytest.approx(1) and np.unravel_index(d.argmax(), d.shape) == (21, 21)
    edge = np.array(dense(lb.density_fixed(points(spark, [(0, 0)], 50, 50), ["frame_id"]), "density", 50, 50))
    assert 0.2 < edge.sum() < 0.5
    assert lb.density_fixed(points(spark, [(50, 3), (3, 50)], 50, 50), ["frame_id"]).count() == 0
    twice = np.array(dense(lb.density_fixed(points(spark, [(20, 20)] * 2, 50, 50), ["frame_id"]), "density", 50, 50))
    assert np.allclose(twice, 2 * d)


def test_points_outside_still_reach_in(spark, dense):
    d = np.array(dense(lb.density_fixed(points(spark, [(-3, 10), (-9, 10)], 30, 30), ["frame_id"]), "density", 30, 30))
    assert 0 < d.sum() < 0.5


def brute_knn(pts, k):
    out = {}
    for i, p in enumerate(pts):
        d = sorted(math.dist(p, q) for j, q in enumerate(pts) if j != i)[:k]
        out[p] = d
    return out


def test_knn_with_cluster_twins_and_far_point(spark):
    rnd = np.random.default_rng(1)
    pts = [tuple(map(int, p)) for p in rnd.integers(0, 30, (60, 2))] + [(5, 5)] * 4 + [(390, 399), (200, 10)]
    out = lb.knn_distances(points(spark, pts, 400, 400), ["frame_id"], 3)
    got = {(r["row"], r["col"]): r["dist"] for r in out.collect()}
    want = brute_knn(pts, 3)
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)


@pytest.mark.parametrize("pts", [[(3, 4)], [(3, 4), (8, 4)], [(3, 4), (8, 4), (3, 9)], [(3, 4), (3, 4), (3, 4), (3, 4)], [(11, 11), (2, 2)]])
def test_adaptive_density_has_unit_mass_per_point(spark, dense, pts):
    d = np.array(dense(lb.density_knn(points(spark, pts, 12, 12), ["frame_id"]), "density", 12, 12))
    assert d.sum() == pytest.approx(len(pts))


def test_adaptive_density_of_one_point(spark, dense):
    d = np.array(dense(lb.density_knn(points(spark, [(3, 4)], 12, 12), ["frame_id"]), "density", 12, 12))
    r, c = np.mgrid[0:12, 0:12]
    want = np.exp(-((r - 3) ** 2 + (c - 4) ** 2) / (2 * 3.0 ** 2))
    assert np.allclose(d, want / want.sum())


def test_label_smoothing_keeps_constants_and_size(raster, dense):
    for f in (lambda d: lb.smooth_labels_2d(d, "v", 5, 2.0), lambda d: lb.smooth_labels_3d(d, "v")):
        assert np.allclose(dense(f(raster([[1.0] * 6] * 4)), "v", 4, 6), 1)


def test_smoothing_kernel_by_definition(raster, dense):
    k, s = 3, 1.0
    img = np.zeros((7, 7))
    img[3, 3] = 1
    got = np.array(dense(lb.smooth_labels_2d(raster(img.tolist()), "v", k, s), "v", 7, 7))
    a = np.exp(-((np.arange(k) - 1) ** 2) / (2 * s * s))
    ker = np.outer(a, a) / a.sum() ** 2
    ker[1, 1] = 1 - ker[1, 1]
    assert np.allclose(got[2:5, 2:5], ker / ker.sum()) and got.sum() == pytest.approx(1)


def test_convolve_equals_two_passes(raster, dense):
    img = [[float((r * 5 + c * 3) % 7) for c in range(6)] for r in range(5)]
    line = rs.gaussian_weights(3, 0.8)
    a = dense(rs.convolve(raster(img), lb.kernel_2d(3, 0.8), ["v"]), "v", 5, 6)
    b = dense(rs.convolve_separable(raster(img), line, ["v"]), "v", 5, 6)
    assert np.allclose(a, b)


def test_upsampling_by_definition(raster, dense):
    up = dense(rs.resample_bilinear(raster([[0.0, 4.0]]), 2, ["v"]), "v", 2, 4)
    assert np.allclose(up, [[0, 1, 3, 4]] * 2)
    zoom = dense(rs.zoom_mask(raster([[0.0, 3.0]]), 2, ["v"]), "v", 2, 4)
    assert np.allclose(zoom, [[0, 1, 2, 3]] * 2)


def test_boundary_weight_and_binarize(spark):
    df = spark.createDataFrame([(0.5,), (0.49,)], "v double").select(lb.boundary_weight("v", 3).alias("w"), lb.binarize("v").alias("b"))
    assert [tuple(r) for r in df.collect()] == [(3.0, 1), (1.0, 0)]


def test_neighbourhoods_cross_block_borders(raster, dense):
    img = np.random.default_rng(2).random((150, 90))
    line = rs.gaussian_weights(7, 1.5)
    got = np.array(dense(rs.convolve_separable(raster(img.tolist()), line, ["v"]), "v", 150, 90))
    pad = np.pad(img, 3, mode="edge")
    down = sum(w * pad[i:i + 150, :] for i, w in enumerate(line))
    assert np.allclose(got, sum(w * down[:, i:i + 90] for i, w in enumerate(line)))
    up = np.array(dense(rs.resample_bilinear(raster(img.tolist()), 3, ["v"]), "v", 450, 270))
    at = lambda n: np.clip((np.arange(3 * n) + 0.5) / 3 - 0.5, 0, n - 1)
    r, c = at(150), at(90)
    r0, c0 = np.minimum(r.astype(int), 148), np.minimum(c.astype(int), 88)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    want = ((1 - fr) * (1 - fc) * img[np.ix_(r0, c0)] + (1 - fr) * fc * img[np.ix_(r0, c0 + 1)]
            + fr * (1 - fc) * img[np.ix_(r0 + 1, c0)] + fr * fc * img[np.ix_(r0 + 1, c0 + 1)])
    assert np.allclose(up, want)


def test_a_convolution_is_one_shuffle(raster):
    plan = rs.convolve_separable(raster([[1.0, 2.0], [3.0, 4.0]]), [0.2, 0.6, 0.2], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_upsampling_of_rasters_that_lack_pixels(spark):
    """Across blocks, with a missing, a null and a doubled pixel: a plan without an aggregate of finer pixels, results by brute force."""
    n, side = 2, 70
    rows = [(r, c, float((r * 31 + c * 17) % 97)) for r in range(side) for c in range(side) if (r, c) != (63, 64)]
    rows = [(r, c, None if (r, c) == (10, 10) else v) for r, c, v in rows] + [(5, 5, 2.0)]
    df = spark.createDataFrame([(1, r, c, side, side, v) for r, c, v in rows], "image_id long, row int, col int, rows int, cols int, v double")
    up = rs.resample_bilinear(df, n, ["v"])
    assert "HashAggregate" not in up._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for r, c, v in rows:
        for pr in {max(0, r * n + d) for d in range(-n, 2 * n)} | {0}:
            for pc in {max(0, c * n + d) for d in range(-n, 2 * n)} | {0}:
                w = [sum(max(0.0, 1 - abs((p + 0.5) / n - 0.5 - a)) for a in ([x] + [-1] * (x == 0) + [side] * (x == side - 1))) for p, x in ((pr, r), (pc, c))]
                if pr < n * side and pc < n * side and w[0] * w[1] > 0:
                    wanted.setdefault((pr, pc), []).append(None if v is None else v * w[0] * w[1])
    got = {(x["row"], x["col"]): x["v"] for x in up.collect()}
    assert got.keys() == wanted.keys()
    for k, parts in wanted.items():
        known = [p for p in parts if p is not None]
        assert (got[k] is None) == (not known) and (not known or got[k] == pytest.approx(sum(known)))


def test_crossings_are_worked_out_once(spark):
    """A row without crossings paints nothing, and no filter repeats the search for crossings."""
    ring = [(2.0, 1.0), (6.0, 1.0), (6.0, 3.0), (2.0, 3.0)]
    df = spark.createDataFrame([(1, 1, ring, 8, 9)], "frame_id long, id long, ring array<struct<x:double,y:double>>, rows int, cols int")
    out = lb.rasterize(df, ["frame_id"], "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "array_sort" in line and line.strip(" :+-").startswith("Filter")]
    got = {(r["row"], r["col"]): r["value"] for r in out.collect()}
    assert got == {(r, c): int(r == 2 and 2 < c < 6) for r in (1, 2, 3) for c in range(2, 7)}
    assert lb.boundary_gaps(df.drop("id"), ["frame_id"]).count() == 0


def test_clip_raster_does_not_broadcast_pixels_exploded_from_few_rows(spark):
    grid = spark.range(3).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("row"))
    pixels = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col"), F.lit(1.0).alias("red"))
    extents = spark.createDataFrame(
        [(7, 1, 2, 3, 5, 4, 0.0, 0.0, 1.0)],
        "frame_id long, image_id long, row0 int, col0 int, rows int, cols int, x0 double, y0 double, res double")
    out = lb.clip_raster(pixels, extents, 8)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["row"], r["col"]) for r in out.collect()) == [(r, c) for r in range(5) for c in range(4)]


def label_run(spark, bands=("red",)):
    """A frame of 150 x 130 pixels, so several tiles, and a small one; crowns with slanted edges across the borders of tiles."""
    from gridlake.plans.label_frames import build_label_frames

    rng = random.Random(3)
    crowns = []
    for i in range(300):
        x, y = rng.uniform(0, 170), rng.uniform(0, 150)
        corners = [(x + rng.uniform(1, 9) * math.cos(t), y + rng.uniform(1, 9) * math.sin(t)) for t in (0, 1.2, 2.5, 3.9, 5.1)]
        crowns.append((i, corners))
    areas = rings(spark, (1, box(10.3, 5.2, 160.1, 134.9)), (2, box(161.0, 0.0, 175.0, 20.0)))
    images = spark.createDataFrame([(5, 0.0, 0.0, 200.0, 160.0), (6, 500.0, 0.0, 510.0, 10.0)], "image_id long, xmin double, ymin double, xmax double, ymax double")
    pixels = spark.createDataFrame([(5, r, c, (r * 7 + c) / 2) for r in range(160) for c in range(200)], "image_id long, row int, col int, red double")
    return crowns, build_label_frames(pixels, images, areas, rings(spark, *crowns), list(bands), 1.0, 64.0, block=16)


def test_label_frames_of_several_tiles_equal_the_operators_on_whole_frames(spark):
    crowns, built = label_run(spark)
    frames = {f["frame_id"]: f for f in built.frames.collect()}
    large = next(f for f in frames.values() if f["area_id"] == 1)
    assert (large["rows"], large["cols"]) == (130, 151) and len(frames) == 2
    kept = {r["id"] for r in built.polygons.where(F.col("frame_id") == large["frame_id"]).collect()}
    assert len(kept) == built.counts.where(F.col("frame_id") == large["frame_id"]).first()["n"] > 200
    shifted = [(i, [(x - large["x0"], large["y0"] - y) for x, y in c]) for i, c in crowns if i in kept]
    polys = grid(spark, shifted, large["rows"], large["cols"])
    whole = [(i, [(float(math.floor(x)), float(math.floor(y))) for x, y in c]) for i, c in shifted]
    want = {(r["row"], r["col"]): r["value"] for r in lb.rasterize(grid(spark, whole, large["rows"], large["cols"]), ["frame_id"], "id").collect()}
    gaps = {(r["row"], r["col"]) for r in lb.boundary_gaps(polys, ["frame_id"]).collect()}
    middle = polys.withColumn("c", g.centroid("ring")).select("frame_id", "rows", "cols", F.floor("c.y").cast("int").alias("row"), F.floor("c.x").cast("int").alias("col"))
    density = {(r["row"], r["col"]): r["density"] for r in lb.density_fixed(middle, ["frame_id"]).collect()}
    got = built.pixels.where(F.col("frame_id") == large["frame_id"]).collect()
    assert len(got) == 130 * 151 and len(want) > 1000 and len(gaps) > 100
    for p in got:
        at = (p["row"], p["col"])
        assert p["red"] == ((p["row"] + large["row0"]) * 7 + p["col"] + large["col0"]) / 2
        assert p["annotation"] == want.get(at, 0) and p["boundary"] == int(at in gaps)
        assert p["density"] == pytest.approx(density.get(at, 0.0), abs=1e-12)


def test_pixels_of_a_label_run_are_not_shuffled(spark):
    _, built = label_run(spark)
    plan = built.pixels._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "row#" in line.split("hashpartitioning(")[1]], "layers meet where their tile was dealt to"
    assert not [line for line in plan if "Exchange" in line and "Union" in plan[plan.index(line) + 1]]


def test_clip_raster_keeps_values_that_16_bits_do_not_hold(spark):
    values = [0.5, -0.0, None, 70000.0, float("nan"), 3.0, -32768.0]
    pixels = spark.createDataFrame([(1, 0, c, v, c) for c, v in enumerate(values)], "image_id long, row int, col int, v double, n long")
    small = pixels.where(F.col("col") > 4).repartition(1)
    extents = spark.createDataFrame(
        [(7, 1, 0, 0, 2, 9, 0.0, 0.0, 1.0)], "frame_id long, image_id long, row0 int, col0 int, rows int, cols int, x0 double, y0 double, res double")
    for df in (pixels.repartition(1), small):
        got = {r["col"]: (str(r["v"]), r["n"]) for r in lb.clip_raster(df, extents, 4).collect()}
        assert got == {r["col"]: (str(r["v"]), r["n"]) for r in df.collect()}


def test_few_crowns_on_one_pixel_of_density_count_each(spark):
    """Points of a frame wider than a part reach over the part's border, and copies count."""
    many = points(spark, [(63, 63)] * 3 + [(64, 70)], 140, 140)
    got = {(r["row"], r["col"]): r["density"] for r in lb.density_fixed(many, ["frame_id"]).collect()}
    kernel = lb.kernel_2d(15, 4.0)
    want = {}
    for r, c, n in ((63, 63, 3), (64, 70, 1)):
        for i in range(15):
            for j in range(15):
                want[r + i - 6, c + j - 6] = want.get((r + i - 6, c + j - 6), 0) + n * kernel[i][j]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
