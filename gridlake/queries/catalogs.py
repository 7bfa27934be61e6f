"""Queries over the catalog, sinks, names and the incremental jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as nm
from ..operators.objects import label_components
from ..plans.inference import score_mosaic
from ..session import ensure_checkpoint_dir
from ..sources import catalog as ct, io
from ..streaming import incremental as inc
from . import fixtures as fx
from .fixtures import S, W, r6 as R, with_ctes
from .registry import query, r6

BRIGHT = 0.85  # score from which on a pixel belongs to an object of the image stream
KINDS = ["click", "error", "purchase", "signup", "view"]


@query(with_ctes(["cat"], """
    SELECT path, event_id FROM cat WHERE path LIKE '%.tif' AND split_part(path, '/', 4) LIKE 'c%' AND split_part(path, '/', 4) NOT LIKE 'cx%'
      AND split_part(path, '/', 3) NOT IN ('d3', 'd4')"""))
def scan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The name rules of the file listing."""
    files = fx.catalog(spark, sf)
    return ct.filter_catalog(files, ".tif", "c", "cx", ["d3", "d4"]).select("path", "event_id")


@query(with_ctes(["cat"], "SELECT frame_key, " + ", ".join(f"min(path) FILTER (band = '{k}') AS {k}" for k in KINDS) + " FROM cat GROUP BY frame_key"))
def pair_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return ct.pair_siblings(fx.catalog(spark, sf), KINDS, "frame_key", "band")


@query(with_ctes(["cat"], """
    SELECT '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/_' || CAST(frame_key AS VARCHAR) || '.tif' AS frame_key, """ + ", ".join(
    f"min(path) FILTER (band = '{k}') AS {k}" for k in KINDS) + " FROM cat GROUP BY 1"))
def pair_siblings_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Frame keys derived from the paths: the band word cut out of the file name."""
    return ct.pair_siblings(fx.catalog(spark, sf).select("path"), KINDS)


@query(with_ctes(["cat", "done"], "SELECT DISTINCT path FROM cat WHERE path NOT IN (SELECT path FROM done)"))
def skip_done(spark: SparkSession, sf: str) -> DataFrame:
    return ct.skip_done(fx.catalog(spark, sf).select("path").distinct(), fx.done(spark, sf))


@query(with_ctes(["cat", "done"], """
    SELECT event_id FROM cat WHERE replace(split_part(path, '/', 4), '.tif', '') NOT IN (SELECT substr(split_part(path, '/', 4), 1, 6) FROM done)"""))
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ct.fill_missing(fx.catalog(spark, sf), fx.done(spark, sf)).select("event_id")


@query("""
    SELECT DISTINCT p_name AS name, 'models/' || p_type || '/' || p_brand || '.h5' AS uri FROM part
    WHERE p_name IN ('red widget', 'small ring') AND regexp_matches('models/' || p_type || '/' || p_brand || '.h5', 'Brand#1[0-9]')""")
def select_models(spark: SparkSession, sf: str) -> DataFrame:
    registry = fx.table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.concat(F.lit("models/"), "p_type", F.lit("/"), "p_brand", F.lit(".h5")).alias("uri"))
    return ct.select_models(registry, ["red widget", "small ring"], "Brand#1[0-9]").distinct()


@query(with_ctes(["cat"], """
    SELECT DISTINCT k.frame_key AS image_id, n.band FROM cat k, (SELECT unnest(['click', 'error', 'view']) AS band) n
    WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.frame_key = k.frame_key AND c.band = n.band)"""))
def check_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Files of an image that a chosen model needs and that are not there."""
    have = fx.catalog(spark, sf).select(F.col("frame_key").alias("image_id"), "band")
    return ct.check_bands(have, {"a": ["click", "error"], "b": ["error", "view", "ndvi"]}, always=("click",))


@query("""
    SELECT unnest(['red widget', 'small ring', 'no such model', 'old net']) AS name EXCEPT SELECT p_name FROM part""")
def unknown_models(spark: SparkSession, sf: str) -> DataFrame:
    registry = fx.table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return ct.unknown_models(registry, ["red widget", "small ring", "no such model", "old net"])


@query("""
    SELECT o_custkey AS image_id, count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('O', 'F')) = 2 AS ndvi FROM orders GROUP BY o_custkey""")
def can_have_ndvi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as images, order states as bands: red and infrared must both be there."""
    band = F.when(F.col("o_orderstatus") == "O", "red").when(F.col("o_orderstatus") == "F", "infrared").otherwise("blue")
    return ct.can_have_ndvi(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"), band.alias("band")))


@query("""
    WITH ranked AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('1117' || '-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS pos,
      count(*) OVER () AS n FROM orders)
    SELECT frame_id, CASE WHEN pos <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS role FROM ranked""")
def load_or_make_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split made and saved, then found again by a run that would draw another."""
    path = f"{ensure_checkpoint_dir(spark)}/split-{uuid.uuid4().hex}"
    frames = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"))
    ct.load_or_make_split(frames, path)
    return ct.load_or_make_split(frames, path, seed=2)


@query(with_ctes(["cat"], """
    SELECT event_id, 'out/' || replace(split_part(path, '/', 4), '.tif', '_seg.tif') AS seg, replace(split_part(path, '/', 4), '.tif', '') AS stem,
      substr(split_part(path, '/', 4), 1, 6) AS prefix, strftime(modificationTime, '%Y%m%d-%H%M') AS stamp,
      'count_' || CAST(frame_key AS VARCHAR) || '.npy' AS count_name, replace(path, 'error', 'density') AS density FROM cat"""))
def output_names(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.catalog(spark, sf)
    return c.select(
        "event_id", nm.output_name("path", ".tif", "_seg", ".tif", "out").alias("seg"), nm.stem("path").alias("stem"),
        nm.name_prefix("path").alias("prefix"), nm.run_stamp("modificationTime").alias("stamp"),
        nm.numbered("count_%d.npy", "frame_key").alias("count_name"), nm.replace_text("path", "error", "density").alias("density"))


@query(with_ctes(["mosaic"], """
    SELECT image_id, row, col, CASE WHEN round(seg, 9) >= 0.5 THEN 1 ELSE 0 END AS seg,
      CAST(trunc(least(32767, greatest(-32768, round(dens, 9) * 10000))) AS SMALLINT) AS dens FROM mosaic"""))
def write_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A mask and a fixed-point density written as partitioned Parquet and read back."""
    from ..plans.inference import score_mosaic

    out = score_mosaic(fx.pixels(spark, sf), [fx.RED], W, W, S)
    out = out.withColumns({"seg": F.round("seg", 9), "dens": F.round("dens", 9)})
    path = f"{ensure_checkpoint_dir(spark)}/mask-{uuid.uuid4().hex}"
    io.write_mask(io.mask_table(out, "seg"), path, "dens", "int16", 32767, th=None, scale="fixed")
    return spark.read.parquet(path).select(F.col("image_id").cast("long").alias("image_id"), "row", "col", "seg", "dens")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def running_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by status kept by a stream that reads the event file to its end."""
    base = f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    stream = inc.stream_pixels(spark, sf, fx.table(spark, sf, "events").schema, name="events.parquet")
    inc.start_running_counts(stream.withColumnRenamed("event_type", "status"), f"{base}/out", f"{base}/state").awaitTermination()
    return inc.latest_counts(spark, f"{base}/out")


@query(f"""
    SELECT vec_id // 100 AS image_id, count(*) AS n_vectors, {r6('sum(list_sum(embedding::DOUBLE[]))')} AS total FROM embeddings GROUP BY 1""")
def process_new_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose vectors lie in three files each, one file a micro-batch; run again, with its checkpoint and without: nothing is new."""
    base = f"{ensure_checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}"
    vectors = fx.table(spark, sf, "embeddings").withColumn("part", F.pmod("vec_id", F.lit(3)))
    vectors.repartition(3, "part").write.partitionBy("part").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema

    def plan(new: DataFrame) -> DataFrame:
        return new.groupBy("image_id").agg(
            F.count(F.lit(1)).alias("n_vectors"),
            F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))

    for state in ("state", "state", "lost"):
        stream = inc.stream_pixels(spark, f"{base}/in", schema, files_per_batch=1)
        stream = stream.withColumn("image_id", F.floor(F.col("vec_id") / 100).cast("long"))
        inc.process_new_images(stream, plan, f"{base}/out", f"{base}/{state}").awaitTermination()
    return inc.read_committed(spark, f"{base}/out").groupBy("image_id").agg(
        F.sum("n_vectors").alias("n_vectors"), R(F.sum("total")).alias("total"))


@query(with_ctes(["mosaic"], """
    SELECT image_id, count(*) AS n_objects, CAST(sum(n) AS BIGINT) AS mask_px, CAST(max(n) AS BIGINT) AS largest FROM (
      SELECT image_id, root, count(*) AS n FROM (
        SELECT image_id, row, col, min(struct_pack(r := r0, c := c0)) AS root FROM reach GROUP BY image_id, row, col) GROUP BY image_id, root)
    GROUP BY image_id""", True, [
        ("obs", f"SELECT image_id, row, col FROM mosaic WHERE round(seg, 9) >= {BRIGHT}::DOUBLE"),
        ("reach", """
          SELECT image_id, row, col, row AS r0, col AS c0 FROM obs
          UNION
          SELECT o.image_id, o.row, o.col, s.r0, s.c0 FROM reach s JOIN obs o ON o.image_id = s.image_id
            AND abs(o.row - s.row) <= 1 AND abs(o.col - s.col) <= 1""")]))
def process_whole_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images cut into stripes that lie in several files, two files a micro-batch: windows, mosaic and objects of each image as a whole.

    Run again, with its checkpoint and without: nothing is new.
    """
    base = f"{ensure_checkpoint_dir(spark)}/whole-{uuid.uuid4().hex}"
    px = fx.pixels(spark, sf).select("image_id", "row", "col", "red")
    stripe = F.floor(F.col("row") / 27).cast("int")
    px.repartition(6, "image_id", stripe).write.parquet(f"{base}/in")
    found = spark.read.parquet(f"{base}/in")
    manifest = found.groupBy("image_id").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n_files"))

    def plan(new: DataFrame) -> DataFrame:
        merged = score_mosaic(new, [fx.RED], W, W, S).filter(F.round("seg", 9) >= BRIGHT)
        sizes = label_components(merged.select("image_id", "row", "col"), block=32).groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("n"))
        return sizes.groupBy("image_id").agg(
            F.count(F.lit(1)).alias("n_objects"), F.sum("n").alias("mask_px"), F.max("n").alias("largest"))

    for state in ("state", "state", "lost"):
        stream = inc.stream_pixels(spark, f"{base}/in", found.schema, files_per_batch=2)
        inc.process_whole_images(stream, manifest, plan, f"{base}/out", f"{base}/{state}").awaitTermination()
    return inc.read_committed(spark, f"{base}/out")
