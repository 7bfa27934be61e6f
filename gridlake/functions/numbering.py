"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .draws import hash_hex

_LEAST_DIGITS = 3  # of the hash; 16**3 = 4096 buckets at least


def bucket_digits(df: DataFrame) -> int:
    """Hash digits that give sixteen buckets or more for each shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(_LEAST_DIGITS, len(f"{partitions * 16 - 1:x}"))


def _bucket_offsets(df: DataFrame, bucket: str) -> DataFrame:
    """(bucket, offset, total): rows before each bucket. One row per bucket, so the ordered window is small."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(bucket)
    return counts.select(
        bucket,
        (F.sum("_n").over(order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )


def hashed_rank(
    df: DataFrame, seed: int | str, ids: list[str], rank: str = "rank", total: str = "total", digits: int | None = None
) -> DataFrame:
    """1-based rank of each row in the order of a seeded hash of ``ids``, and the row count.

    Rows are bucketed on the leading hash digits (uniform whatever the data), ranked inside
    the bucket, and shifted by the rows of the buckets before it. Buckets grow in number with the
    cluster (``digits``), not with the rows, so their offsets stay small.
    """
    hashed = df.withColumn("_h", hash_hex(seed, *[F.col(i) for i in ids]))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits or bucket_digits(df)))
    inside = Window.partitionBy("_b").orderBy("_h", *ids)
    offsets = _bucket_offsets(hashed, "_b")
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_b")  # a row for each bucket
        .withColumn(rank, (F.col("_before") + F.col("_r")).cast("long"))
        .withColumn(total, F.col("_total").cast("long"))
        .drop("_h", "_b", "_r", "_before", "_total")
    )


def ordered_number(df: DataFrame, order: list[str | Column], name: str, partitions: int | None = None) -> DataFrame:
    """0-based running number in the order of ``order`` over the whole table.

    Range-partitions on the order key and freezes that placement in the checkpoint folder,
    so that the per-partition counts and the rows agree even if executors are lost.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut_lineage(df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()))
    offsets = _bucket_offsets(placed, "_p")
    inside = Window.partitionBy("_p").orderBy(*keys)
    return (
        placed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_p")  # one row per partition
        .withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long"))
        .drop("_p", "_r", "_before", "_total")
    )
