"""Reproducible random draws: a hash of (seed, ids), so retries and re-planning give the same data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPAN = 4294967296  # 2**32, the range of the eight hex digits used


def hash_hex(seed: int | str, *ids: Column) -> Column:
    """md5 over ``seed-id1-id2…`` as hex text; any SQL engine can repeat it."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_long(seed: int | str, *ids: Column) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(hash_hex(seed, *ids), 1, 8), 16, 10).cast("long")


def hash01(seed: int | str, *ids: Column) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return hash_long(seed, *ids) / F.lit(float(_SPAN))


def hash_index(n: Column, seed: int | str, *ids: Column) -> Column:
    """Uniform integer in [0, n); 0 where n is not positive."""
    n = n.cast("long")
    return F.when(n > 0, F.pmod(hash_long(seed, *ids), F.greatest(n, F.lit(1)))).otherwise(F.lit(0)).cast("int")


def hash_range(lo: float, hi: float, seed: int | str, *ids: Column) -> Column:
    """Uniform DOUBLE in [lo, hi)."""
    return F.lit(float(lo)) + hash01(seed, *ids) * F.lit(float(hi) - float(lo))
