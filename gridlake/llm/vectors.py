"""Integer vectors from arrays of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Integer components stay below this, so that squared distances of a few hundred components fit a BIGINT.
LARGEST = 1 << 27


def is_whole(vector: Column) -> Column:
    """True if the vector and all its components are there and finite; never null."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component x as BIGINT; a component of LARGEST or more is an error, as its distances have no BIGINT."""

    def one(x: Column) -> Column:
        y = F.lit(float(SCALE)) * x.cast("double")
        told = F.raise_error(F.concat(F.lit("vector component too large: "), x.cast("string"))).cast("bigint")
        return F.when(F.abs(y) < F.lit(float(LARGEST)), F.floor(y)).otherwise(told)

    return F.transform(vector, one)


def kept(df: DataFrame, id: str, vector: str, fits: Column, *carry: str) -> DataFrame:
    """(id, v, carry...) of rows whose vector is whole and ``fits``; ``v`` are its integers. ``carry`` are columns of ``df``, numbered c0, c1, ..."""
    whole = F.col(f"`{vector}`")
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    return df.filter(is_whole(whole) & fits).select(F.col(f"`{id}`").alias("id"), integers(whole).alias("v"), *named)
