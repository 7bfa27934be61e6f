"""Training patches as arrays: one shuffle brings a patch together, one Arrow pass transforms it at every resolution it has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Pixels that are transformed at once, whatever the patches' size.
STEP_PIXELS = 1 << 20


#: Column of the positions a patch has pixels for; after ``transformed`` one yes or no a position.
THERE = "there"


def to_patches(pixels: DataFrame, size: int, keys: list[str], values: list[str], there: str = THERE) -> DataFrame:
    """(keys, there, values...): the pixels of each patch in row-major order, ``there`` are their positions.

    Patches at the rim of what an image has pixels for may be short of some. Of rows at one position the last in the order of their values counts.
    """
    at = (F.col("row") * F.lit(size) + F.col("col")).cast("int").alias("at")
    inside = F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1)
    rows = pixels.where(inside).select(*keys, F.struct(at, *[F.col(v).cast("double").alias(v) for v in values]).alias("p"))
    sorted_rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))  # size² of them
    return sorted_rows.select(*keys, F.col("p.at").alias(there), *[F.col(f"p.{v}").alias(v) for v in values])


def from_patches(patches: DataFrame, size: int, keys: list[str], values: list[str], there: str = THERE) -> DataFrame:
    """(keys, row, col, values...) of the pixels that patches have after ``transformed``."""
    long = patches.select(*keys, F.posexplode(F.arrays_zip(there, *values)).alias("at", "p")).where(F.col(f"p.{there}"))
    row, col = F.floor(F.col("at") / F.lit(size)).cast("int"), F.pmod("at", F.lit(size)).cast("int")
    return long.select(*keys, row.alias("row"), col.alias("col"), *[F.col(f"p.{v}").alias(v) for v in values])


def bilinear(values: np.ndarray, known: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patches (n, size, size) read at fractional positions that broadcast to their shape, and where a pixel that is ``known`` was read.

    Edges are repeated half a pixel outwards, beyond is 0. Pixels that are not known add nothing.
    """
    n, high, wide = values.shape
    row, col = np.broadcast_to(row, values.shape), np.broadcast_to(col, values.shape)
    r0, c0 = np.floor(row), np.floor(col)
    full = bool(known.all())
    flat, held, out = np.where(known, values, 0.0).reshape(n, -1), known.reshape(n, -1), 0.0
    reached = np.full(values.shape, full)
    for dr in (0, 1):
        for dc in (0, 1):
            weight = (row - r0 if dr else 1 - (row - r0)) * (col - c0 if dc else 1 - (col - c0))
            at = (np.clip(r0 + dr, 0, high - 1).astype(np.int64) * wide + np.clip(c0 + dc, 0, wide - 1).astype(np.int64)).reshape(n, -1)
            out = out + weight * np.take_along_axis(flat, at, 1).reshape(values.shape)
            if not full:
                reached |= np.take_along_axis(held, at, 1).reshape(values.shape)
    inside = (row >= -0.5) & (row <= high - 0.5) & (col >= -0.5) & (col <= wide - 0.5)
    return np.where(inside, out, 0.0), reached


Positions = Callable[[int, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _per_patch(x: np.ndarray) -> np.ndarray:
    return x.astype(float)[:, None, None]


def crop_positions(size: int, draws: dict[str, np.ndarray], scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Where a patch that was cropped and stretched back reads: ``top``, ``bottom``, ``left``, ``right`` are pixels of full resolution, ``scale`` of them a pixel."""
    at = np.arange(size)

    def along(first: str, last: str, positions: np.ndarray) -> np.ndarray:
        start, extent = _per_patch(draws[first]) / scale, size - (_per_patch(draws[first]) + _per_patch(draws[last])) / scale
        return start + np.maximum(0.0, np.minimum((positions + 0.5) * extent / size - 0.5, extent - 1))

    return along("top", "bottom", at[None, :, None]), along("left", "right", at[None, None, :])


def affine_positions(size: int, draws: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where a patch moved by the linear part (a, b, c, d) and the shift (tx, ty) about its centre reads."""
    a, b, c, d, tx, ty = (_per_patch(draws[k]) for k in ("a", "b", "c", "d", "tx", "ty"))
    mid, at = (size - 1) / 2, np.arange(size)
    x, y = at[None, None, :] - mid - tx, at[None, :, None] - mid - ty
    det = a * d - b * c
    return (a * y - c * x) / det + mid, (d * x - b * y) / det + mid


#: An array of a patch and where its values are known.
Known = tuple[np.ndarray, np.ndarray]


def _dense(part: pa.RecordBatch, name: str, there: str, side: int) -> Known:
    """The pixels of each patch at their places, 0 and not known where there is none."""
    places = part.column(there)
    patch = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
    at = patch * side * side + places.flatten().to_numpy(zero_copy_only=False)
    values, known = np.zeros(part.num_rows * side * side), np.zeros(part.num_rows * side * side, bool)
    if name == there:
        known[at] = True
    else:
        held = part.column(name).flatten()
        sure = held.is_valid().to_numpy(zero_copy_only=False)
        values[at] = np.where(sure, held.to_numpy(zero_copy_only=False), 0.0)
        known[at] = sure
    return values.reshape(-1, side, side), known.reshape(-1, side, side)


def transformed(
    patches: DataFrame, keys: list[str], draws: dict[str, Column], work: Callable[[dict[str, Known], dict[str, np.ndarray]], dict[str, Known]],
    sizes: dict[str, int], there: dict[str, str] | None = None,
) -> DataFrame:
    """Patches of ``to_patches`` with each array of ``sizes`` (name to side) replaced by what ``work`` makes of (arrays by name, draws by name).

    ``there`` names the positions of each array if it is not THERE. All arrays come back as size² values, null where ``work`` does not know them, positions as
    size² times yes or no. Draws are expressions of the keys, one value a patch; they are taken on the JVM, so that a patch gets the same ones wherever it is transformed.
    """
    of = {n: (there or {}).get(n, THERE) for n in sizes}
    sides = sizes | {of[n]: s for n, s in sizes.items()}
    of |= {t: t for t in of.values()}
    source = patches.select(*keys, *sides, *[c.alias(f"_{n}") for n, c in draws.items()])
    kind = lambda n: T.BooleanType() if of[n] == n else T.DoubleType()
    schema = T.StructType([*[source.schema[k] for k in keys], *[T.StructField(n, T.ArrayType(kind(n))) for n in sides]])
    step, names = max(1, STEP_PIXELS // max(s * s for s in sides.values())), list(draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                arrays = {n: _dense(part, n, of[n], s) for n, s in sides.items()}
                done = work(arrays, {n: part.column(f"_{n}").to_numpy(zero_copy_only=False) for n in names})
                out = [part.column(k) for k in keys]
                for n, s in sides.items():
                    offsets, (values, known) = pa.array(np.arange(part.num_rows + 1) * s * s, pa.int32()), done[n]
                    flat = pa.array(known.reshape(-1)) if of[n] == n else pa.array(values.reshape(-1), pa.float64(), mask=~known.reshape(-1))
                    out.append(pa.ListArray.from_arrays(offsets, flat))
                yield pa.RecordBatch.from_arrays(out, [*keys, *sides])

    return source.mapInArrow(run, schema)


def resampled(
    pixels: DataFrame, size: int, keys: list[str], values: list[str], draws: dict[str, Column], positions: Positions, grow: bool = False
) -> DataFrame:
    """Patches of pixel rows, read bilinearly at ``positions``: one shuffle, no join.

    A patch keeps the positions it has pixels for, if one is read there; with ``grow`` it gets all at which one is read.
    """
    def work(arrays: dict[str, Known], drawn: dict[str, np.ndarray]) -> dict[str, Known]:
        row, col = positions(size, drawn)
        done = {n: bilinear(*x, row, col) for n, x in arrays.items()}
        if not grow:
            done[THERE] = done[THERE][0], done[THERE][1] & arrays[THERE][1]
        return done

    patches = to_patches(pixels, size, keys, values)
    return from_patches(transformed(patches, keys, draws, work, dict.fromkeys(values, size)), size, keys, values)
