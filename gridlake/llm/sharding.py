"""Shards that all hold the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def shard_rows(
    df: DataFrame, n_shards: int = 24, source: str = "source", ids: tuple[str, ...] = ("doc_id",), seed: int = 7, buckets: int | None = None
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Rows are ranked within their source in the order of a seeded hash of ``ids``; row r of n gets the fraction
    (r-u)/n, u being a hash of the source between 0 and 1; all rows in the order of that fraction are cut into shards whose counts are at most
    one apart, so a shard holds of every source its share, to within a row or two. By u the sources of a row each are spread over all shards
    and buckets, too. Equal fractions are ordered by source, hash and ``ids``; rows equal in all of these take their places in any order.

    A source that holds most rows is ranked in ``buckets`` hash ranges (default: four for each shuffle partition), and so is
    the order over all, as fractions are spread evenly. Only bucket counts are summed up in order.

    ``df`` is read twice and must give the same rows. A null source is a source of its own; null ids hash like any value; repeated rows get a place each; an empty table
    gives none. Columns named ``shard`` or ``slot`` in ``df`` are replaced.
    """
    many = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.struct("*").alias("row"), F.col(source).alias("s"), F.xxhash64(F.lit(seed), *ids).alias("h"))
    keyed = keyed.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(many)))
    per = keyed.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    of_source = Window.partitionBy("s")
    before = per.select(
        F.col("s").alias("s2"), F.col("b").alias("b2"),
        (F.sum("n").over(of_source.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(of_source).alias("total"),
    )
    shift = (F.pmod(F.xxhash64(F.lit(seed + 1), "s"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    tie = ["h", *[F.col(f"row.`{i}`") for i in ids]]
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy(*tie)))
    ranked = ranked.join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).withColumn(
        "f", (F.col("before") + F.col("r") - shift) / F.col("total"))
    ranked = ranked.withColumn("g", F.floor(F.col("f") * many)).select("row", "s", "h", "f", "g")

    counts = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        F.col("g").alias("g2"), (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("f", "s", *tie)) - 1
    placed = ranked.withColumn("p", place).join(F.broadcast(starts), F.col("g") == F.col("g2"))  # a row for each bucket
    placed = placed.withColumn("p", F.col("p") + F.col("before"))
    shard = F.expr(f"p * {n_shards} div total")
    out = placed.withColumn("shard", shard).withColumn("slot", F.expr(f"p - (shard * total + {n_shards - 1}) div {n_shards}"))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return out.select(*kept, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **how: object) -> None:
    """Writes one folder for each shard, its rows in slot order in files of bounded size."""
    sharded = shard_rows(df, **how)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
