"""Tables in the shared folder, and joins in which one key may hold a third of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir

#: Parts that the rows of a key are dealt to.
SALTS = 64


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, read again: it is computed once, and survives lost executors.

    Small files are read many to a task; a checkpoint leaves a task for each of its partitions, even empty ones, to whatever reads it, and unions add them up.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def look_up(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a ``key``; the rows of a key are dealt by the column ``by``.

    ``table`` is repeated for the parts that a key's rows are in, so never for more rows than there are.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    told = dealt.select(key, "_salt").distinct().join(table, key)
    return dealt.join(told, [key, "_salt"]).drop("_salt")
