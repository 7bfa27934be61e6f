import os

import pytest
from pyspark.sql import functions as F

from gridlake.functions.draws import hash01, hash_index
from gridlake.operators import sampling as sp, tiling as tl
from gridlake.plans.training import training_batches, write_epoch
from gridlake.sources import catalog as ct, io
from gridlake.streaming import incremental as inc

KEYS = ["frame_id"]


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(4000).select(hash01(1, F.col("id")).alias("u"), hash_index(F.lit(7), 1, F.col("id")).alias("i"), hash_index(F.lit(0), 1, F.col("id")).alias("z"))
    r = df.agg(F.avg("u"), F.min("i"), F.max("i"), F.max("z")).first()
    assert abs(r[0] - 0.5) < 0.02 and (r[1], r[2], r[3]) == (0, 6, 0)


def test_folds_are_disjoint_and_complete(spark):
    frames = spark.range(103).withColumnRenamed("id", "frame_id")
    folds = sp.kfold(frames)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3 and folds.select("frame_id").distinct().count() == 103
    again = {tuple(r) for r in sp.kfold(frames.repartition(7)).collect()}
    assert again == {tuple(r) for r in folds.collect()}
    few = sp.kfold(spark.range(3).withColumnRenamed("id", "frame_id"))
    assert few.count() == 3 and few.select("fold").distinct().count() == 3


def test_validation_share(spark):
    split = sp.train_val_split(spark.range(11).withColumnRenamed("id", "frame_id"))
    assert {r["role"]: r["count"] for r in split.groupBy("role").count().collect()} == {"val": 3, "train": 8}


def patch(spark, n=8):
    rows = [(f, r, c, float(f * 100 + r * n + c)) for f in range(6) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "frame_id int, row int, col int, v double")


def test_flip_twice_is_identity(spark):
    p = patch(spark)
    twice = sp.flip_lr(sp.flip_lr(p, 8, 3, KEYS), 8, 3, KEYS)
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in p.collect()}
    once = sp.flip_ud(p, 8, 3, KEYS, p=1.0)
    assert once.where("frame_id = 0 and row = 7 and col = 0").first()["v"] == 0


@pytest.mark.parametrize("op", [
    lambda p: sp.random_crop_resize(p, 8, 1, KEYS, ["v"], share=0.3, p=1.0),
    lambda p: sp.affine(p, 8, 1, KEYS, ["v"], p=1.0),
    lambda p: sp.blur(p, 8, 1, KEYS, ["v"], p=1.0),
    lambda p: sp.channel_multiply(p, 1, KEYS, ["v"], p=1.0),
])
def test_augmented_patches_stay_full_and_repeat(spark, op):
    a = {(r["frame_id"], r["row"], r["col"]): r["v"] for r in op(patch(spark)).collect()}
    b = {(r["frame_id"], r["row"], r["col"]): r["v"] for r in op(patch(spark).repartition(5)).collect()}
    assert len(a) == 6 * 64 and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_identity_affine(spark):
    same = sp.affine(patch(spark), 8, 1, KEYS, ["v"], 1.0, (1, 1), (0, 0), (0, 0), (0, 0))
    got = {(r["frame_id"], r["row"], r["col"]): r["v"] for r in same.collect()}
    assert all(got[(r["frame_id"], r["row"], r["col"])] == pytest.approx(r["v"]) for r in patch(spark).collect())


def test_epoch_repeats_whatever_the_partitioning(spark, tmp_path):
    px = patch(spark, 12).select("frame_id", "row", "col", F.col("v").alias("red"), (F.col("v") % 2).cast("int").alias("annotation"),
                                 (F.col("v") % 3 == 0).cast("int").alias("boundary"), (F.col("v") / 100).alias("density"))
    frames = spark.range(6).select(F.col("id").cast("int").alias("frame_id"), F.lit(12).alias("rows"), F.lit(12).alias("cols"))
    args = (1, 3, 4, 5, ["red"])
    a = training_batches(frames, px, *args)
    b = training_batches(frames.repartition(3), px.repartition(4), *args)
    rounded = lambda df: sorted(tuple(round(float(x), 9) for x in r) for r in df.collect())
    assert rounded(a) == rounded(b) and a.count() == 3 * 4 * 25
    other = training_batches(frames, px, 2, 3, 4, 5, ["red"])
    assert rounded(other) != rounded(a)
    write_epoch(a, str(tmp_path / "t"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300


def test_scan_catalog(spark, tmp_path):
    for name in ("a/red_1.tif", "a/green_1.tif", "a/red_2.tif", "skip/red_3.tif", "a/red_1.txt", "a/pred_1.tif"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    cat = ct.scan_catalog(spark, str(tmp_path), ".tif", not_prefix="pred", exclude_dirs=["skip"])
    assert sorted(os.path.basename(r["path"]) for r in cat.collect()) == ["green_1.tif", "red_1.tif", "red_2.tif"]
    assert ct.scan_catalog(spark, str(tmp_path / "a"), ".tif", "red", recursive=False).count() == 2
    rows = {os.path.basename(r["frame_key"]): (r["red"] is not None, r["green"] is not None) for r in ct.pair_siblings(cat, ["red", "green"]).collect()}
    assert rows == {"_1.tif": (True, True), "_2.tif": (True, False)}


def test_registry_checks(spark):
    reg = spark.createDataFrame([("rgb", ["red", "green", "blue"], "u1"), ("nir", ["red", "infrared", "ndvi"], "u2")], "name string, bands array<string>, uri string")
    assert [r["name"] for r in ct.unknown_models(reg, ["rgb", "other"]).collect()] == ["other"]
    assert ct.select_models(reg, ["rgb", "nir"], "2$").count() == 1
    have = spark.createDataFrame([(1, b) for b in ("red", "green", "blue", "infrared")] + [(2, "red"), (2, "green"), (2, "blue")], "image_id int, band string")
    assert [tuple(r) for r in ct.check_bands(have, {"rgb": ["red"], "nir": ["red", "infrared", "ndvi"]}).collect()] == [(2, "infrared")]
    assert {r["image_id"]: r["ndvi"] for r in ct.can_have_ndvi(have).collect()} == {1: True, 2: False}


def test_split_is_cached(spark, tmp_path):
    frames = spark.range(20).withColumnRenamed("id", "frame_id")
    path = str(tmp_path / "split")
    first = {tuple(r) for r in ct.load_or_make_split(frames, path).collect()}
    assert {tuple(r) for r in ct.load_or_make_split(frames, path, seed=2).collect()} == first
    with pytest.raises(Exception):
        ct.save_split(frames, path)


def test_areas_are_numbered_and_layers_must_agree(spark, tmp_path):
    ring = "array<struct<x:double,y:double>>"
    a = spark.createDataFrame([("b", 1, None), ("a", 1, None)], f"area_key string, srid int, ring {ring}")
    a.write.parquet(str(tmp_path / "areas"))
    got = {r["area_key"]: r["id"] for r in io.read_areas(spark, str(tmp_path / "areas")).collect()}
    assert got == {"a": 0, "b": 1}
    io.require_same_crs(a, a)
    with pytest.raises(ValueError):
        io.require_same_crs(a, a.withColumn("srid", F.lit(2)))


def test_sinks(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 0.7), (1, 0, 1, 0.2), (2, 0, 0, float("nan"))], "image_id long, row int, col int, seg double")
    path = str(tmp_path / "m")
    io.write_mask(px, path, "seg")
    back = spark.read.parquet(path)
    assert sorted((r["image_id"], r["col"], r["seg"]) for r in back.collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 0)]
    assert back.schema["seg"].metadata == {"nodata": 255}
    assert os.path.isdir(path + "/image_id=1")
    heights = spark.createDataFrame([(9999,), (12,)], "h int").select(io.nodata_to_null("h", io.nodata_for("height")).alias("h"))
    assert [r["h"] for r in heights.collect()] == [None, 12]
    polys = spark.createDataFrame([(7, 1, [(0, 0), (0, 2), (2, 0)])], "frame_id int, id int, pixels array<struct<row:int,col:int>>")
    io.write_annotation_json(polys, str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"Trees":[[[0,0],[0,2],[2,0]]]}']
    frames = spark.createDataFrame([(7,), (8,)], "frame_id int")
    io.write_frame_counts(frames, polys, str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {(7, 1), (8, 0)}


def test_sampled_frames_fill_every_slot_whatever_their_ids(spark):
    frames = spark.createDataFrame([(0, 9, 9), (5, 9, 9), (70, 9, 9)], "frame_id int, rows int, cols int")
    got = tl.sample_frames(frames, 5, 4, 3).collect()
    assert len(got) == 20 and {r["frame_id"] for r in got} == {0, 5, 70}
    assert tl.sample_frames(frames.limit(0), 5, 4, 3).count() == 0


def test_small_frames_are_padded(spark):
    px = spark.range(100).select(
        F.lit(4).alias("frame_id"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("red"),
        F.lit(1).alias("annotation"), F.lit(1).alias("boundary"), F.lit(0.5).alias("density"))
    frames = spark.createDataFrame([(4, 10, 10)], "frame_id int, rows int, cols int")
    for augment in (False, True):
        got = training_batches(frames, px, 0, 2, 3, 16, ["red"], augment=augment)
        assert got.groupBy("step", "slot").count().where("count != 256").isEmpty() and got.count() == 6 * 256
    plain = training_batches(frames, px, 0, 2, 3, 16, ["red"], augment=False)
    outside = plain.where("row > 9 or col > 9")
    assert outside.count() == 6 * 156 and outside.where("red != 0 or ann != 0 or weight != 1 or density != 0").isEmpty()
    assert plain.where("row < 10 and col < 10 and ann = 1 and weight = 5").count() == 600


def test_new_files_are_processed_once(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = spark.createDataFrame([], "image_id long, v double").schema

    def arrive(*ids):
        spark.createDataFrame([(i, float(i)) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)

    def run(where=state):
        inc.process_new_images(inc.stream_pixels(spark, source, schema, 1), lambda b: b, out, where).awaitTermination()
        return sorted(r["image_id"] for r in inc.read_committed(spark, out).collect())

    arrive(1, 2)
    assert run() == [1, 2]
    assert run() == [1, 2]
    arrive(2, 3)
    arrive(2)
    assert run() == [1, 2, 2, 2, 3], "image 2 has parts in three files, each in a micro-batch of its own"
    assert run(str(tmp_path / "other")) == [1, 2, 2, 2, 3], "the commits outlive the checkpoint"


class Crash(RuntimeError):
    pass


def crash_before(monkeypatch, name, times):
    """The first so many calls of ``name`` fail, as when the driver dies there."""
    real, left = getattr(inc, name), [times]

    def run(*a):
        if left[0]:
            left[0] -= 1
            raise Crash(name)
        return real(*a)

    monkeypatch.setattr(inc, name, run)


@pytest.mark.parametrize("checkpoint", ["kept", "lost"])
def test_results_without_a_commit_are_not_read_and_come_again(spark, tmp_path, monkeypatch, checkpoint):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "image_id long, v double").schema
    for i in range(4):
        spark.createDataFrame([(i, 1.0), (9, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)

    def run(files, state):
        inc.process_new_images(inc.stream_pixels(spark, source, schema, files), lambda b: b, out, str(tmp_path / state)).awaitTermination()

    with pytest.raises(FileNotFoundError):
        inc.read_committed(spark, out)
    crash_before(monkeypatch, "commit", 1)
    with pytest.raises(Exception, match="commit"):
        run(3, "state")
    assert len(os.listdir(f"{out}/data")) == 1 and inc.committed(spark, out).count() == 0
    run(2, "state" if checkpoint == "kept" else "other")
    got = sorted(r["image_id"] for r in inc.read_committed(spark, out).collect())
    assert got == [0, 1, 2, 3, 9, 9, 9, 9], "files in batches of another size, the folder of the failed run left out"
    assert inc.committed(spark, out).count() == 4


def images_in_files(spark, path, parts):
    """parts: for each file its (image, value) rows."""
    schema = spark.createDataFrame([], "image_id long, v double").schema
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return schema


def whole(batch):
    """One row an image: how often it was processed and what of it was there."""
    return batch.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@pytest.mark.parametrize("files", [1, 2, 5])
def test_images_are_processed_whole_and_once(spark, tmp_path, files):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(1, 1.0), (2, 10.0)], [(2, 20.0)], [(1, 2.0), (3, 100.0)], [(2, 40.0), (4, 7.0)], [(1, 4.0)], [(9, 1.0)]]
    schema = images_in_files(spark, source, parts)
    manifest = spark.createDataFrame([(1, 3), (2, 3), (3, 1), (4, 2)], "image_id long, n_files int")  # a file of 4 is yet to come; 9 is not named

    def run(state):
        inc.process_whole_images(inc.stream_pixels(spark, source, schema, files), manifest, whole, out, str(tmp_path / state)).awaitTermination()
        return sorted(tuple(r) for r in inc.read_committed(spark, out).collect())

    three = [(1, 3, 7.0), (2, 3, 70.0), (3, 1, 100.0)]
    assert run("state") == three and run("state") == three
    images_in_files(spark, source, [[(4, 8.0)]])
    four = [*three, (4, 2, 15.0)]
    assert run("state") == four and run("lost") == four


@pytest.mark.parametrize("step", ["commit", "publish"])
@pytest.mark.parametrize("checkpoint", ["kept", "lost"])
def test_whole_images_survive_a_crash(spark, tmp_path, monkeypatch, step, checkpoint):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = images_in_files(spark, source, [[(1, 1.0), (2, 1.0)], [(1, 2.0)], [(2, 2.0)]])
    manifest = spark.createDataFrame([(1, 2), (2, 2)], "image_id long, n_files int")

    def run(files, state):
        inc.process_whole_images(inc.stream_pixels(spark, source, schema, files), manifest, whole, out, str(tmp_path / state)).awaitTermination()

    crash_before(monkeypatch, step, 1)
    with pytest.raises(Exception, match=step):
        run(3, "state")
    run(1, "state" if checkpoint == "kept" else "other")
    assert sorted(tuple(r) for r in inc.read_committed(spark, out).collect()) == [(1, 2, 3.0), (2, 2, 3.0)]
    assert sorted(r["unit"] for r in inc.committed(spark, out).collect()) == ["1", "2"]


def test_images_that_wait_too_long_are_reported(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = images_in_files(spark, source, [[(1, 1.0)], [(2, 1.0)]])
    manifest = spark.createDataFrame([(1, 2), (2, 1)], "image_id long, n_files int")
    for f in os.listdir(source):
        if f.endswith(".parquet"):
            os.utime(f"{source}/{f}", (1_700_000_000, 1_700_000_000))

    def run():
        inc.process_whole_images(inc.stream_pixels(spark, source, schema, 1), manifest, whole, out, state, timeout=60_000).awaitTermination()

    run()
    assert not os.path.exists(f"{out}/late"), "nothing is newer than the image's own file"
    images_in_files(spark, source, [[(2, 1.0)], [(2, 1.0)]])  # files of a later time
    run()
    assert {(r["image_id"], r["n_files"]) for r in spark.read.parquet(f"{out}/late").collect()} == {(1, 1)}
    images_in_files(spark, source, [[(1, 5.0)]])
    run()
    assert sorted(tuple(r) for r in inc.read_committed(spark, out).collect()) == [(1, 2, 6.0), (2, 1, 1.0)]


def test_running_totals(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string").write.parquet(source)
    stream = inc.stream_pixels(spark, source, spark.read.parquet(source).schema)
    inc.start_running_counts(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in inc.latest_counts(spark, str(tmp_path / "t")).collect()} == {("ok", 2), ("failed", 1)}


class FakeSession:
    """Just what ``ensure_checkpoint_dir`` looks at."""

    def __init__(self, named, current, master):
        self.calls = []
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: named if k == "spark.checkpoint.dir" else d)})
        self.sparkContext = type("Context", (), {
            "master": master, "getCheckpointDir": staticmethod(lambda: current), "setCheckpointDir": staticmethod(self.calls.append)})


def test_checkpoint_folder_comes_from_the_session():
    from gridlake.session import ensure_checkpoint_dir

    s = FakeSession("/shared/ckpt", None, "yarn")
    assert ensure_checkpoint_dir(s) == "/shared/ckpt" and s.calls == ["/shared/ckpt"]
    s = FakeSession("/shared/ckpt", "file:/shared/ckpt/abc", "yarn")
    assert ensure_checkpoint_dir(s) == "/shared/ckpt" and s.calls == []
    s = FakeSession(None, "/other", "yarn")
    assert ensure_checkpoint_dir(s) == "/other" and s.calls == []
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(FakeSession(None, None, "yarn"))


def test_patches_that_lack_pixels_equal_sql(spark, tmp_path):
    """Images of which the last vectors are missing, so that patches at their rim are short of pixels or have none."""
    import oracle
    from conftest import SF

    for t in oracle.TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / "embeddings.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors.where("vec_id < 256 and vec_id % 97 <> 5").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    from gridlake.queries import ORACLE, QUERIES

    for name in ("affine", "random_crop_resize", "training_batches_augmented", "two_resolution_batches", "training_batches_plain"):
        assert oracle.compare(QUERIES[name](spark, str(tmp_path)), con, ORACLE[name]) is None, name
