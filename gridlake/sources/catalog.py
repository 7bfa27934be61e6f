"""Image catalog: listing, pairing, skipping, and the checks before a run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import basename, name_prefix, stem
from ..operators.sampling import kfold, train_val_split


def scan_catalog(
    spark: SparkSession, directory: str, suffix: str = "", prefix: str = "", not_prefix: str = "",
    exclude_dirs: list[str] | None = None, recursive: bool = True,
) -> DataFrame:
    """path, length, modificationTime of the matching files; the contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", f"{prefix}*{suffix}").load(directory)
        .select("path", "length", "modificationTime")
    )
    return filter_catalog(files, suffix, prefix, not_prefix, exclude_dirs)


def filter_catalog(
    files: DataFrame, suffix: str = "", prefix: str = "", not_prefix: str = "", exclude_dirs: list[str] | None = None
) -> DataFrame:
    """The name rules of ``scan_catalog`` on any table with a ``path``."""
    name = basename("path")
    if suffix:
        files = files.where(F.endswith(F.col("path"), F.lit(suffix)))
    if prefix:
        files = files.where(F.startswith(name, F.lit(prefix)))
    if not_prefix:
        files = files.where(~F.startswith(name, F.lit(not_prefix)))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    for d in exclude_dirs or []:
        files = files.where(~F.array_contains(folders, d))
    return files


def pair_siblings(catalog: DataFrame, bands: list[str], key: str | None = None, band: str | None = None) -> DataFrame:
    """One row per frame with the path of each band's file; the pivot values are fixed, so one aggregation does it."""
    if key is None or band is None:
        b, k = F.regexp_extract(basename("path"), f"^({'|'.join(bands)})", 1), F.regexp_replace(
            "path", f"(^|/)({'|'.join(bands)})(?=[^/]*$)", "$1")
        catalog = catalog.withColumns({"frame_key": k, "band": b}).where(F.col("band") != "")
        key, band = "frame_key", "band"
    return catalog.groupBy(key).pivot(band, bands).agg(F.min("path"))


def skip_done(catalog: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Inputs without an existing output."""
    return catalog.join(done.select(key), key, "left_anti")


def fill_missing(catalog: DataFrame, done: DataFrame, n: int = 6) -> DataFrame:
    """Inputs whose stem is not among the n-character name prefixes of the done list."""
    names = done.select(name_prefix("path", n).alias("_k"))
    return catalog.withColumn("_k", stem("path")).join(names, "_k", "left_anti").drop("_k")


def select_models(registry: DataFrame, in_use: list[str], pattern: str | None = None) -> DataFrame:
    chosen = registry.where(F.col("name").isin(in_use))
    return chosen.where(F.col("uri").rlike(pattern)) if pattern else chosen


def unknown_models(registry: DataFrame, in_use: list[str]) -> DataFrame:
    """Names asked for that the registry does not have."""
    asked = registry.sparkSession.createDataFrame([(n,) for n in in_use], "name string")
    return asked.join(registry.select("name"), "name", "left_anti")


def needed_bands(
    models: dict[str, list[str]], always: tuple[str, ...] = ("red", "green", "blue"), derived: tuple[str, ...] = ("ndvi",)
) -> list[str]:
    """Bands the chosen models (name → bands) read from files."""
    return sorted(({b for bands in models.values() for b in bands} | set(always)) - set(derived))


def check_bands(
    image_bands: DataFrame, models: dict[str, list[str]], always: tuple[str, ...] = ("red", "green", "blue")
) -> DataFrame:
    """(image_id, band) of every needed band an image lacks. ``image_bands`` is (image_id, band).

    One aggregation: each image keeps a set of at most as many bands as are needed.
    """
    needed = F.array(*[F.lit(b) for b in needed_bands(models, always)])
    known = F.when(F.array_contains(needed, F.col("band")), F.col("band"))
    have = image_bands.groupBy("image_id").agg(F.collect_set(known).alias("have"))
    return have.select("image_id", F.explode(F.array_except(needed, F.col("have"))).alias("band"))


def can_have_ndvi(image_bands: DataFrame) -> DataFrame:
    """(image_id, ndvi): whether red and infrared are there, so that the derived band can be added."""
    hit = F.sum(F.col("band").isin("red", "infrared").cast("int"))
    return image_bands.distinct().groupBy("image_id").agg((hit == 2).alias("ndvi"))


def load_or_make_split(
    frames: DataFrame, path: str, n: int | None = None, val: float = 0.2, seed: int = 1117, key: str = "frame_id"
) -> DataFrame:
    """The split at ``path`` if there is one, else a new k-fold (``n``) or train/val split, written there first."""
    spark = frames.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        split = kfold(frames, n, seed, key) if n else train_val_split(frames, val, seed, key)
        save_split(split, path)
        return spark.read.parquet(path)


def save_split(split: DataFrame, path: str) -> None:
    split.write.mode("errorifexists").parquet(path)
