"""Session helpers: a default local session and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # local tables are small, but a row may stand for thousands of pixels: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only a local session may fall back to one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        # the context adds a folder of its own below the one it is given
        if current is None or _plain(current).rpartition("/")[0] != _plain(named):
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="gridlake-ckpt-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(own)
    return own


def _plain(path: str) -> str:
    """A path without its file scheme and last slash."""
    return "/" + path.removeprefix("file:").strip("/") if path.startswith(("file:", "/")) else path.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-spreads rows that are about to multiply.

    The partition count is given, as AQE would size it by the bytes of the few rows there are
    now and leave too few tasks for the many they become.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
