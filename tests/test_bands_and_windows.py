import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import bands as fb
from gridlake.operators import mosaic as mo, tiling as tl
from gridlake.operators.scoring import LinearModel, ensemble_nanmean, score
from gridlake.plans import block_inference as bi, inference as inf


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_ieee_divide(spark):
    d = lambda a, b: one(spark, fb.ieee_divide(F.lit(float(a)), F.lit(float(b))))
    assert math.isnan(d(0, 0)) and d(1, 0) == math.inf and d(-1, 0) == -math.inf and d(6, 3) == 2
    assert one(spark, fb.ieee_divide(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_population_deviation_and_epsilon(raster, dense):
    px = raster([[1, 2], [3, 4]])
    z = dense(fb.normalize_patch(px, ["image_id"], ["v"]), "v", 2, 2)
    want = (np.array([[1, 2], [3, 4.0]]) - 2.5) / (np.std([1, 2, 3, 4]) + 1e-8)
    assert np.allclose(z, want)
    flat = dense(fb.normalize_patch(raster([[5, 5]]), ["image_id"], ["v"]), "v", 1, 2)
    assert flat == [[0.0, 0.0]]


def test_nan_spreads_over_its_window(raster):
    px = raster([[1, float("nan")], [3, 4]])
    assert all(math.isnan(r["v"]) for r in fb.normalize_patch(px, ["image_id"], ["v"]).collect())


def test_threshold_is_inclusive_and_nan_is_no_object(spark):
    t = lambda v: one(spark, fb.threshold(F.lit(v)))
    assert (t(0.5), t(0.49), t(float("nan"))) == (1, 0, 0)


def test_casts_clamp(spark):
    c = lambda v, t: one(spark, fb.cast_dtype(F.lit(v), t))
    assert (c(300.0, "uint8"), c(-3.0, "uint8"), c(2.9, "uint8"), c(float("nan"), "uint8")) == (255, 0, 2, 0)
    assert (c(40000.0, "int16"), c(-40000.0, "int16")) == (32767, -32768)


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_global_quartiles_of_float_bands(spark, most):
    """Few values may be ordered at once, so the sketch has to narrow them down; ties, nulls, no numbers, one value."""
    rnd = np.random.default_rng(8)
    a, b = rnd.normal(0, 5, 4001), rnd.integers(0, 4, 4001).astype(float)
    rows = [(float(x), float(y), None, 7.5 if i == 9 else None, float("nan") if i % 2 else float(x)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, none double, one double, half double").repartition(5)
    got = {r["band"]: (r["q1"], r["q3"]) for r in fb.global_quartiles(df, ["a", "b", "none", "one", "half"], most, 50).collect()}
    assert got.keys() == {"a", "b", "one", "half"} and got["one"] == (7.5, 7.5)
    assert got["a"] == pytest.approx(tuple(np.percentile(a, [25, 75]))) and got["b"] == tuple(np.percentile(b, [25, 75]))
    assert got["half"][0] == pytest.approx(np.sort(a[::2])[1000]) and math.isnan(got["half"][1])


def test_global_quartiles_of_a_skewed_band(spark):
    df = spark.createDataFrame([(float(v),) for v in [7] * 300 + list(range(100))], "v double")
    row = fb.global_quartiles(df, ["v"]).first()
    assert (row["q1"], row["q3"]) == tuple(np.quantile([7] * 300 + list(range(100)), [0.25, 0.75]))


@pytest.mark.parametrize("stride,count", [(224, 529), (64, 6241)])
def test_window_grid_of_a_demonstration_tile(spark, stride, count):
    img = spark.createDataFrame([(0, 5000, 5000)], "image_id long, rows int, cols int")
    g = tl.window_grid(img, 256, 256, stride)
    assert g.count() == count
    first = [tuple(r) for r in g.orderBy("seq").select("win_col", "win_row").limit(3).collect()]
    assert first == [(0, 0), (0, stride), (0, 2 * stride)]
    last = g.orderBy(F.desc("seq")).first()
    assert last["w"] == 5000 - last["win_col"] and last["seq"] == count - 1


@pytest.mark.parametrize("width,stride", [(4, 4), (5, 3), (6, 2), (3, 5), (4, 3)])
def test_every_pixel_is_in_the_windows_that_cover_it(spark, raster, width, stride):
    px = raster([[c + 10 * r for c in range(11)] for r in range(7)])
    got = {(r["win_col"], r["win_row"], r["row"], r["col"]) for r in tl.tile_pixels(px, width, width, stride).collect()}
    want = {(wc, wr, r, c) for r in range(7) for c in range(11) for wc in range(0, 11, stride) for wr in range(0, 7, stride)
            if wc <= c < wc + width and wr <= r < wr + width}
    assert got == want


@pytest.mark.parametrize("width,stride", [(4, 4), (5, 3), (6, 2), (4, 3), (3, 5)])
@pytest.mark.parametrize("op", mo.OPERATORS)
def test_merge_by_cells_equals_merge_by_window_rows(spark, raster, width, stride, op):
    rnd = random.Random(3)
    px = raster([[rnd.randint(0, 255) for _ in range(11)] for _ in range(7)], "red")
    m = [LinearModel("m", ("red",), (1.5,), -0.2)]
    a = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in inf.score_mosaic(px, m, width, width, stride, op).collect()}
    b = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in inf.score_mosaic_tiled(px, m, width, width, stride, op).collect()}
    assert a.keys() == b.keys() and len(a) == 77, "pixels between windows stay, at the canvas's first value"
    assert all(np.allclose(a[k], b[k]) for k in a)
    images = px.select("image_id", "rows", "cols").distinct()
    for border in (0, 1):
        whole = inf.score_mosaic(px, m, width, width, stride, op, border, images=images)
        want = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in whole.collect()}
        model = inf.score_mosaic_model(px, images, m[0].scorer, ["red"], width, width, stride, op, border)
        got = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in model.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        if op in bi.OPERATORS:
            for size in (4, 16):
                blocks = bi.score_blocks(tl.to_blocks(px, ["red"], size), images, [bi.BandModel("m", ("red",), m[0].scorer)], size, width, width, stride, op, border, batch=3)
                got = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in tl.from_blocks(blocks, ["seg", "dens"]).collect()}
                assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_blocks_are_scored_without_pixel_rows(spark, raster):
    """Several networks, each with its own bands; one of them useless where its band has no number."""
    rnd = np.random.default_rng(2)
    px = raster(rnd.integers(0, 99, (12, 12)).tolist(), "red").withColumn("nir", F.when(F.col("col") < 6, F.lit(float("nan"))).otherwise(F.col("red") * 2.0))
    models = [LinearModel("a", ("red",), (1.0,)), LinearModel("b", ("nir", "red"), (0.5, -0.2))]
    images = px.select("image_id", "rows", "cols").distinct()
    blocks = tl.to_blocks(px, ["nir", "red"], 4)
    out = bi.score_blocks(blocks, images, [bi.BandModel(m.name, m.bands, m.scorer) for m in models], 4, 6, 6, 3)
    want = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in inf.score_mosaic(px, models, 6, 6, 3).collect()}
    got = {(r["row"], r["col"]): (r["seg"], r["dens"]) for r in tl.from_blocks(out, ["seg", "dens"]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    stored = spark.createDataFrame(blocks.collect(), blocks.schema)
    plan = bi.score_blocks(stored, images, [bi.BandModel("a", ("red",), models[0].scorer)], 4, 6, 6, 3)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("FlatMapGroupsInArrow") == 2
    with pytest.raises(ValueError):
        bi.score_blocks(stored, images, [], 4, 6, 6, 3, "MEAN")


def merged_by_windows(shape, width, height, stride, op, heads_of, scale=1, start=0.0):
    """One raster a head, window by window in their order: ``heads_of(r, c, h, w)`` gives the heads of a window."""
    rows, cols = shape
    out = None
    for c in range(0, cols, stride):
        for r in range(0, rows, stride):
            h, w = min(height, rows - r), min(width, cols - c)
            heads = heads_of(r, c, h, w)
            if out is None:
                out = np.full((len(heads), rows // scale, cols // scale), start)
            at = (slice(None), slice(r // scale, (r + h) // scale), slice(c // scale, (c + w) // scale))
            old, new = out[at], np.stack(heads)
            if op == "MAX":
                out[at] = np.maximum(old, new)
            elif op == "MIN":
                out[at] = np.minimum(old, new)
            elif op == "REPLACE":
                out[at] = new
            else:
                mixed = np.where(old != 0, old / 2 + new / 2, old)
                out[at] = np.where(mixed == 0, new, mixed)
    return out


def raster_of(blocks, head, shape, **where):
    out = np.full(shape, np.nan)
    for b in blocks.collect():
        if all(b[k] == v for k, v in where.items()):
            out[b["rows"], b["cols"]] = b[head]
    return out


def zscored(x):
    return (x - x.mean()) / (x.std() + 1e-8)


def two_resolutions(raster, rows=20, cols=28):
    rnd = np.random.default_rng(7)
    full, half = rnd.integers(0, 99, (rows, cols)).astype(float), rnd.integers(0, 30, (rows // 2, cols // 2)).astype(float)
    px, low = raster(full.tolist(), "red"), raster(half.tolist(), "height")
    return full, half, px, low, px.select("image_id", "rows", "cols").distinct()


def scorers():
    """(network of two inputs, network with one coarse head), nested so that they travel to the workers by value."""
    def both_inputs():
        def run(x, low):
            wide = np.repeat(np.repeat(low[..., 0], 2, axis=1), 2, axis=2)
            return x[..., 0] + wide, x[..., 0] * 2 - wide

        return run

    def coarse_head():
        def run(x, low):
            n, h, w, _ = x.shape
            return (x[..., 0].reshape(n, h // 2, 2, w // 2, 2).mean(axis=(2, 4)) * 0.5 + low[..., 0],)

        return run

    return both_inputs, coarse_head


@pytest.mark.parametrize(("op", "size", "width", "stride"), [("MAX", 8, 8, 6), ("MIX", 4, 12, 4), ("MIX", 32, 10, 10), ("MIN", 8, 10, 4), ("REPLACE", 4, 6, 4)])
def test_blocks_of_two_resolutions(raster, op, size, width, stride):
    both_inputs, coarse_head = scorers()
    full, half, px, low, images = two_resolutions(raster)
    blocks, half_blocks = tl.to_blocks(px, ["red"], size), tl.to_blocks(low, ["height"], size // 2)
    model = bi.BandModel("two", ("red",), both_inputs, ("height",))
    got = bi.score_blocks(blocks, images, [model], size, width, width, stride, op, half_blocks=half_blocks, batch=3)

    def heads(r, c, h, w):
        x, wide = zscored(full[r:r + h, c:c + w]), half[r // 2:(r + h) // 2, c // 2:(c + w) // 2].repeat(2, 0).repeat(2, 1)
        return x + wide, x * 2 - wide

    want = merged_by_windows(full.shape, width, width, stride, op, heads)
    for k, head in enumerate(("seg", "dens")):
        assert np.allclose(raster_of(got, head, full.shape), want[k])

    got = bi.score_height_blocks(blocks, half_blocks, images, [bi.BandModel("h", ("red",), coarse_head, ("height",))], size, width, width, stride, op, batch=2)

    def coarse(r, c, h, w):
        x = zscored(full[r:r + h, c:c + w]).reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
        return (x * 0.5 + half[r // 2:(r + h) // 2, c // 2:(c + w) // 2],)

    want = merged_by_windows(full.shape, width, width, stride, op, coarse, 2)
    assert np.allclose(raster_of(got, "height", half.shape), want[0])


def test_two_resolutions_ask_for_even_windows_and_both_inputs(raster):
    _, _, px, low, images = two_resolutions(raster)
    blocks, half_blocks = tl.to_blocks(px, ["red"], 8), tl.to_blocks(low, ["height"], 4)
    model = bi.BandModel("two", ("red",), scorers()[0], ("height",))
    for how in ({}, {"half_blocks": half_blocks, "stride": 3}, {"half_blocks": half_blocks, "upscale": 2}):
        with pytest.raises(ValueError):
            bi.score_blocks(blocks, images, [model], **({"size": 8, "width": 8, "height": 8, "stride": 8} | how))


@pytest.mark.parametrize("op", ["MAX", "MIX"])
def test_blocks_keep_one_result_a_model(raster, op):
    full, _, px, _, images = two_resolutions(raster)
    models = [LinearModel("a", ("red",), (1.0,)), LinearModel("b", ("red",), (-0.3,), 0.2)]
    got = bi.score_blocks(tl.to_blocks(px, ["red"], 8), images, [bi.BandModel(m.name, m.bands, m.scorer) for m in models], 8, 10, 10, 6, op, each_model=True)
    for m in models:
        one = inf.score_mosaic(px, [m], 10, 10, 6, op).collect()
        want = np.full(full.shape, np.nan)
        for r in one:
            want[r["row"], r["col"]] = r["seg"]
        assert np.allclose(raster_of(got, "seg", full.shape, model_id=m.name), want)


@pytest.mark.parametrize(("factor", "size", "width", "stride", "op"), [(2, 8, 10, 6, "MAX"), (3, 4, 6, 6, "MIX"), (2, 64, 8, 4, "MIN")])
def test_finer_scoring_goes_beyond_the_windows_border(raster, factor, size, width, stride, op):
    full, _, px, _, images = two_resolutions(raster, 18, 23)
    got = bi.score_blocks(tl.to_blocks(px, ["red"], size), images, [bi.BandModel("m", ("red",), lambda: lambda x: (x[..., 0], 0.1 * x[..., 0] ** 2))],
                          size, width, width, stride, op, upscale=factor, batch=3)
    fine = full
    for axis in (0, 1):
        n = full.shape[axis]
        at = np.clip((np.arange(n * factor) + 0.5) / factor - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, n - 1), (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        fine = np.take(fine, low, axis) * (1 - share) + np.take(fine, high, axis) * share

    def heads(r, c, h, w):
        x = zscored(fine[r * factor:(r + h) * factor, c * factor:(c + w) * factor])
        mean = lambda v: v.reshape(h, factor, w, factor).mean(axis=(1, 3))
        return mean(x), mean(0.1 * x ** 2) * factor ** 2

    want = merged_by_windows(full.shape, width, width, stride, op, heads)
    for k, head in enumerate(("seg", "dens")):
        assert np.allclose(raster_of(got, head, full.shape), want[k])


def test_whole_inference_against_arrays(spark, raster):
    rnd = np.random.default_rng(5)
    img = rnd.integers(0, 255, (9, 13)).astype(float)
    w, s = 6, 4
    want = np.zeros_like(img)
    for c in range(0, 13, s):
        for r in range(0, 9, s):
            part = img[r:r + w, c:c + w]
            z = (part - part.mean()) / (part.std() + 1e-8)
            want[r:r + w, c:c + w] = np.maximum(want[r:r + w, c:c + w], 1 / (1 + np.exp(-z)))
    out = inf.score_mosaic(raster(img.tolist(), "red"), [LinearModel("m", ("red",), (1.0,))], w, w, s)
    got = np.zeros_like(img)
    for r in out.collect():
        got[r["row"], r["col"]] = r["seg"]
    assert np.allclose(got, want)


def test_scores_need_one_shuffle_of_the_pixels(spark, raster):
    """Join and merge share the partitioning on the cell: no exchange on single pixels."""
    px = raster([[float(r * c % 7) for c in range(16)] for r in range(16)], "red")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = inf.score_mosaic(px, [LinearModel("m", ("red",), (1.0,))], 8, 8, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("row#" in line.split("hashpartitioning")[1].replace("cell_row#", "").replace("win_row#", "") for line in exchanges)


def windows(spark, rows):
    return spark.createDataFrame(
        [(0, c, 0, 0, 0, float(v)) for c, v in rows], "image_id long, win_col int, win_row int, row int, col int, v double")


def merged(spark, op, values, **kw):
    return mo.mosaic(windows(spark, list(enumerate(values))), op, ["v"], **kw).first()["v"]


def test_merge_operators(spark):
    nan = float("nan")
    assert merged(spark, "MAX", [-3, -1]) == 0
    assert math.isnan(merged(spark, "MAX", [0.5, nan]))
    assert merged(spark, "MIN", [0.4, 0.2]) == 0
    assert merged(spark, "MIN", [0.4, 0.2], init=-1) == 0.2
    assert math.isnan(merged(spark, "MIN", [0.4, nan], init=-1))
    assert merged(spark, "REPLACE", [0.4, 0.2]) == 0.2
    assert merged(spark, "MIX", [0.4, 0.2]) == pytest.approx(0.3)
    assert merged(spark, "MIX", [0.0, 0.2, 0.4]) == pytest.approx(0.3)
    assert merged(spark, "MIX", [0.4, -0.4]) == pytest.approx(-0.4), "a blend of 0 gives way to the new value"
    with pytest.raises(ValueError):
        merged(spark, "SUM", [1])


def test_border_is_of_the_clipped_window(spark, raster):
    px = raster([[1.0] * 6 for _ in range(5)])
    img = spark.createDataFrame([(0, 5, 6)], "image_id long, rows int, cols int")
    out = mo.suppress_border(tl.tile_pixels(px.drop("rows", "cols"), 4, 4, 4), ["v"], 1, 4, 4, img)
    kept = {(r["win_col"], r["win_row"], r["row"], r["col"]) for r in out.where("v = 1").collect()}
    assert kept == {(0, 0, r, c) for r in (1, 2) for c in (1, 2)}


def test_max_of_an_untouched_image_is_the_image(raster, dense):
    img = [[float((r * 7 + c * 3) % 11) for c in range(9)] for r in range(6)]
    t = tl.tile_pixels(raster(img), 4, 4, 3)
    assert dense(mo.mosaic(t, "MAX", ["v"]), "v", 6, 9) == img


def test_nanmean(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (2, float("nan"))], "k int, v double")
    out = {r["k"]: r["v"] for r in ensemble_nanmean(df, ["k"], ["v"]).collect()}
    assert out[1] == 2.0 and math.isnan(out[2])
    assert math.isnan(one(spark, fb.nanmean([F.lit(float("nan")), F.lit(float("nan"))])))


def test_sequential_patches_have_an_exclusive_end(spark):
    f = spark.createDataFrame([(1, 10, 4), (2, 4, 3), (3, 12, 9)], "frame_id int, rows int, cols int")
    got = {}
    for r in tl.sequential_patches(f, 4, 3).collect():
        got.setdefault(r["frame_id"], set()).add((r["patch_row"], r["patch_col"]))
    assert got[1] == {(0, 0), (3, 0)}
    assert got[2] == {(0, 0)}
    assert got[3] == {(r, c) for r in (0, 3, 6) for c in (0, 3)}


def test_pad_patch_fills_with_zeros_and_ignores_gaps(spark, raster):
    px = raster([[1, 2, 3], [4, 5, 6], [7, 8, 9]]).where("v <> 5")
    rows = {(r["win_col"], r["win_row"]): r["v"] for r in tl.pad_patch(tl.tile_pixels(px, 2, 2, 2), ["v"], 2, 2).collect()}
    assert rows[(0, 0)] == [1, 2, 4, 0] and rows[(2, 2)] == [9, 0, 0, 0] and rows[(2, 0)] == [3, 0, 6, 0]


def test_scorer_sees_batches(spark, raster):
    patches = tl.pad_patch(tl.tile_pixels(raster([[float(i) for i in range(8)]]), 1, 1, 1), ["v"], 1, 1).coalesce(1)

    def load():
        return lambda x: (np.full(x.shape[:3], float(len(x))),)

    out = score(patches, load, ["v"], 1, 1, heads=("n",), batch_rows=3)
    assert sorted(r["n"][0] for r in out.collect()) == [2, 2, 3, 3, 3, 3, 3, 3]


def test_literal_window_is_pushed_to_the_scan(spark, raster, tmp_path):
    blocks = tl.to_blocks(raster([[float(r * 8 + c) for c in range(8)] for r in range(8)]), ["v"], 4)
    blocks.write.parquet(str(tmp_path / "b"))
    box = tl.read_box(spark.read.parquet(str(tmp_path / "b")), ["v"], 4, 2, 5, 3, 2)
    assert sorted(r["v"] for r in box.collect()) == [21.0, 22.0, 29.0, 30.0, 37.0, 38.0]
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_row,0)" in plan.split("PushedFilters")[1]


def test_statistics_and_scores_share_the_shuffle_of_the_pixels(spark, raster):
    px = raster([[float(r * c % 7) for c in range(16)] for r in range(16)], "red").unionByName(
        spark.createDataFrame([(None, 1, 1, 5.0, 16, 16), (0, None, 1, 5.0, 16, 16)], "image_id long, row int, col int, red double, rows int, cols int"))
    out = inf.score_mosaic(px, [LinearModel("m", ("red",), (1.0,))], 8, 8, 4)
    rows = out.collect()
    assert len(rows) == 256 and all(r["row"] is not None for r in rows)
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final and "SortMergeJoin" not in final
