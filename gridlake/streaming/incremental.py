"""New files and new images only, each once: file streams, images gathered in keyed state, and results that count once they are committed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.catalog import skip_done

FILE, ARRIVED = "source_file", "source_time"


def stream_pixels(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, name: str = "") -> DataFrame:
    """Pixel or block files as they arrive under ``path``, with the file of each row as ``source_file`` and its time as ``source_time``; ``name`` is a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumns({FILE: F.col("_metadata.file_path"), ARRIVED: F.col("_metadata.file_modification_time")})


# --- commits ---------------------------------------------------------------------------------------------------

_COMMIT = "unit string, folder string"


def committed(spark: SparkSession, output: str) -> DataFrame:
    """(unit, folder): what is finished, and the folder under ``output`` that holds its result."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{output}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def read_committed(spark: SparkSession, output: str) -> DataFrame:
    """All results whose commit is there. A folder without one was left by a run that failed and is not read."""
    folders = [r["folder"] for r in committed(spark, output).select("folder").distinct().collect()]  # one a micro-batch
    if not folders:
        raise FileNotFoundError(f"nothing is committed under {output}")
    return spark.read.parquet(*[f"{output}/data/{f}" for f in sorted(folders)])


def commit(units: DataFrame, folder: str, output: str) -> None:
    """Makes ``folder`` count. All units of a folder are one file, which is there or not."""
    units.select(F.col(units.columns[0]).cast("string").alias("unit"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{output}/commits")


def publish(result: DataFrame, units: DataFrame, output: str) -> None:
    """Writes ``result`` into a folder of its own, then commits it for ``units``."""
    folder = uuid.uuid4().hex
    result.write.parquet(f"{output}/data/{folder}")
    commit(units, folder, output)


def _open_units(units: DataFrame, output: str) -> DataFrame:
    """``units`` (one column) without those committed; kept, as it is read more than once."""
    name = units.columns[0]
    done = committed(units.sparkSession, output).select(F.col("unit").cast(units.schema[name].dataType).alias(name))
    return units.distinct().join(done, name, "left_anti").persist()


# --- by file -------------------------------------------------------------------------------------------------------


def process_new_images(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: str = "image_id", done: str | None = None,
) -> StreamingQuery:
    """Runs ``plan`` on the rows of files not processed yet; ``read_committed`` gives all results under ``output``.

    The unit is the file: an image that comes in several files, in one micro-batch or in many, is processed file by file, and sums over its
    parts are sums over the output; for plans that need an image whole there is ``process_whole_images``. Finished files are known by their
    commits, which also hold when the stream's checkpoint is lost. A result counts from its commit on, so a run that
    fails between both leaves a folder nobody reads, and its files come again, in whatever batches. ``done`` names a table of keys
    finished elsewhere, whose rows are skipped.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        files = _open_units(batch.select(FILE), output)
        if not files.isEmpty():
            new = batch.join(files, FILE, "left_semi")
            if done:
                new = skip_done(new, new.sparkSession.read.parquet(done), key)
            publish(plan(new.drop(FILE, ARRIVED)), files, output)
        files.unpersist()

    return _started(stream.writeStream.foreachBatch(run), checkpoint)


def _started(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- by image ------------------------------------------------------------------------------------------------------


def _distinct_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image, file, time) once a batch of rows, so that no pixel reaches the state."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


def _gathered(timeout: int | None):
    """Files of an image that have come so far; the image is released when none is missing, and reported each time it has waited too long."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected, latest = state.get if state.exists else ([], 0, 0)
        late = state.hasTimedOut
        if not late:
            found = set(seen)
            for part in parts:
                found.update(part[FILE])
                expected = int(part["n_files"].iloc[0])
                latest = max(latest, int(part[ARRIVED].max().timestamp() * 1000))
            seen = sorted(found)
        whole = len(seen) >= expected
        if whole:
            state.remove()
        else:
            state.update((seen, expected, latest))
            if timeout is not None:
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + timeout)
        if whole or late:
            yield pd.DataFrame({"unit": [key[0]], "files": [seen], "whole": [whole]})

    return run


def gather_images(stream: DataFrame, manifest: DataFrame, key: str = "image_id", timeout: int | None = None) -> DataFrame:
    """(key, files, whole) as images become complete: a stream of pixel files and a table (key, n_files) of how many each image has.

    The state holds file names of incomplete images only, never pixels, and goes when the image is whole. An image whose last file is ``timeout``
    milliseconds older than the newest file of the stream is reported with ``whole`` false, and goes on waiting. Time is that of the files, so
    a run over all that is there ends. Images that the manifest does not name are left out.
    """
    kind = stream.schema[key].dataType.simpleString()
    arrived = stream.select(key, FILE, ARRIVED).mapInArrow(_distinct_files, f"`{key}` {kind}, {FILE} string, {ARRIVED} timestamp")
    if timeout is not None:
        arrived = arrived.withWatermark(ARRIVED, "0 seconds")
    expected = manifest.select(key, F.col("n_files").cast("int").alias("n_files"))
    gathered = arrived.join(expected, key).groupBy(key).applyInPandasWithState(
        _gathered(timeout), f"unit {kind}, files array<string>, whole boolean", "files array<string>, expected int, latest long", "update",
        GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.EventTimeTimeout)
    return gathered.withColumnRenamed("unit", key)


def process_whole_images(
    stream: DataFrame, manifest: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: str = "image_id",
    timeout: int | None = None,
) -> StreamingQuery:
    """Runs ``plan`` once on all pixels of each image, when its last file has come; ``read_committed`` gives all results under ``output``.

    ``stream`` comes from ``stream_pixels``; images lie in any number of files, files hold any number of images, in any order and any batches.
    When an image is whole, its files are read back from storage, those of all images of a micro-batch in one pass. So windows, mosaics and
    components see the image as if it had been one file. An image is committed with its result: after a failure in between, a lost checkpoint or a replay it is
    processed again only if its commit is not there. Reports of images that wait too long go to ``output``/late.
    """
    spark = stream.sparkSession
    schema = StructType([f for f in stream.schema.fields if f.name not in (FILE, ARRIVED)])

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        images = _open_units(batch.filter("whole").select(key), output)
        if not images.isEmpty():
            files = batch.join(images, key).select(F.explode("files").alias("f")).distinct()
            # names of files, as many as the stream's source itself has listed on the driver
            pixels = spark.read.schema(schema).parquet(*[r["f"] for r in files.collect()])
            publish(plan(pixels.join(images, key, "left_semi")), images, output)
        late = batch.filter("not whole")
        if not late.isEmpty():
            late.select(key, F.size("files").alias("n_files"), F.lit(batch_id).alias("batch")).write.mode("append").parquet(f"{output}/late")
        images.unpersist()
        batch.unpersist()

    return _started(gather_images(stream, manifest, key, timeout).writeStream.outputMode("update").foreachBatch(run), checkpoint)


# --- totals ----------------------------------------------------------------------------------------------------------


def running_counts(stream: DataFrame, status: str = "status") -> DataFrame:
    """Processed and failed totals so far; use with output mode ``update`` or ``complete``."""
    return stream.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def start_running_counts(stream: DataFrame, path: str, checkpoint: str, status: str = "status") -> StreamingQuery:
    """Writes the totals after each micro-batch, each into its own folder under ``path``."""
    def write(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(running_counts(stream, status).writeStream.outputMode("complete").foreachBatch(write), checkpoint)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last micro-batch."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(last, "batch").drop("batch")
