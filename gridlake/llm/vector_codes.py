"""Product codes of integer vectors, trained exactly over blocks along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .chunks import squeeze, unsqueeze
from .shared import look_up, stored
from .vectors import kept

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block; components that the curve runs through, and bits of each.
BLOCK_ROWS, CURVE_DIMENSIONS, CURVE_BITS = 64, 8, 7


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``points`` (components below 2**bits, of at most 63 bits in all) along a Hilbert curve.

    The published transform between axes and the transposed index: undo the excess rotations from the top bit down, take the Gray code, interleave.
    """
    x = points.T.astype(np.uint64).copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = (place << one) | ((row >> np.uint64(b)) & one)
    return place.view(np.int64)


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to some vector in the box: no farther from it than the box's farthest corner is from another entry."""
    near = np.maximum(np.maximum(lo - book, book - hi), 0)
    far = np.maximum(np.abs(book - lo), np.abs(hi - book))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(rows: np.ndarray, book: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row over the entries ``listed`` in ascending order; of equally near ones the smaller number.

    Integers throughout: as doubles, in one matrix product, where all of them stay below 2**53, else as 64-bit integers.
    """
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * rows.shape[1] * largest * largest < 1 << 53 else np.int64
    x, y = rows.astype(kind), book[listed].astype(kind)
    away = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    at = away.argmin(1)
    return listed[at], away[np.arange(len(at)), at].astype(np.int64)


_BLOCK = "n int, rows binary, lo array<long>, hi array<long>, total array<long>"


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, length)


def _placed(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """``rows`` with ``h``, their place on the curve through the components that vary most in each part."""
    v = F.col("v")
    figures = [f(v[i]).alias(f"{name}{i}") for i in range(length) for name, f in (
        ("lo", F.min), ("hi", F.max), ("spread", lambda c: F.var_pop(c.cast("double"))))]
    told = rows.agg(*figures).first()
    width, each = length // parts, max(1, CURVE_DIMENSIONS // parts)
    axes = [i for start in range(0, length, width) for i in sorted(range(start, start + width), key=lambda i: -told[f"spread{i}"])[:each]]
    axes = axes[: 63 // CURVE_BITS]
    lo = np.array([told[f"lo{i}"] for i in axes], dtype=np.int64)
    span = np.maximum(np.array([told[f"hi{i}"] for i in axes], dtype=np.int64) - lo, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column("v"), length)[:, axes] - lo) * ((1 << CURVE_BITS) - 1) // span
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(at, CURVE_BITS), pa.int64())], [*batch.schema.names, "h"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("h", LongType())]))


def _blocks(rows: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """Blocks of neighbours on the curve: the vectors, their ids and carried columns, and the box and sum of all components.

    Equal vectors are one place on the curve, so they are dealt by a hash of the id as well.
    """
    carried = [c for c in rows.columns if c != "v"]
    placed = _placed(rows, length, parts).withColumn("salt", F.xxhash64("id", "v"))
    sorted_rows = placed.repartitionByRange("h", "salt").sortWithinPartitions("h", "salt").select(F.struct(*carried).alias("row"), "v")
    schema = f"held array<{sorted_rows.schema['row'].dataType.simpleString()}>, {_BLOCK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                v = _matrix(part.column("v"), length)
                one = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
                held = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), part.column("row"))
                yield pa.RecordBatch.from_arrays(
                    [held, pa.array([len(v)], pa.int32()), pa.array([squeeze(v.T.astype(np.int32).copy().reshape(-1))], pa.binary()),
                     one(v.min(0), pa.int64()), one(v.max(0), pa.int64()), one(v.sum(0), pa.int64())],
                    ["held", "n", "rows", "lo", "hi", "total"])

    return stored(sorted_rows.mapInArrow(run, schema))


def _each_part(block: dict, books: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    width = books.shape[2]
    lo, hi = np.array(block["lo"], dtype=np.int64), np.array(block["hi"], dtype=np.int64)
    for p, book in enumerate(books):
        at = slice(p * width, (p + 1) * width)
        yield p, at, shortlist(lo[at], hi[at], book)


def _vectors(block: dict, length: int) -> np.ndarray:
    return unsqueeze(block["rows"], np.int32).reshape(length, -1).T.astype(np.int64)


def _sums(books: np.ndarray) -> Callable:
    """Adds up, over all blocks of a task, the vectors that each entry is nearest to; a block with one entry listed adds its sum unread."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                v = None
                for p, at, listed in _each_part(block, books):
                    if len(listed) == 1:
                        count[p, listed[0]] += block["n"]
                        total[p, listed[0]] += np.array(block["total"][at], dtype=np.int64)
                        continue
                    v = _vectors(block, parts * width) if v is None else v
                    entry, _ = nearest(v[:, at], books[p], listed)
                    count[p] += np.bincount(entry, minlength=entries)
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    total[p, used] += np.add.reduceat(v[order, at], first, axis=0)
        p, e = np.nonzero(count)
        names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *[pa.array(total[p, e, i]) for i in range(width)]], names)

    return run


def _trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    width = books.shape[2]
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part int, entry int, n long", *[f"{s} long" for s in names]])
    for _ in range(rounds):
        found = blocks.drop("held").mapInArrow(_sums(books), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        before, books = books, books.copy()
        for r in found.collect():  # a row an entry of the codebooks at most
            books[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
        if np.array_equal(before, books):
            break
    return books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            for i, block in enumerate(batch.drop_columns(["held"]).to_pylist()):
                v = _vectors(block, parts * width)
                codes, error = [], np.zeros(len(v), np.int64)
                for p, at, listed in _each_part(block, books):
                    entry, away = nearest(v[:, at], books[p], listed)
                    codes.append(entry)
                    error += away
                text = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack(codes, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([held.slice(i, 1).flatten(), pa.array(text, pa.string()), pa.array(error)], ["row", "code", "error"])

    schema = f"row {blocks.schema['held'].dataType.elementType.simpleString()}, code string, error long"
    return blocks.mapInArrow(run, schema)


def compress(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """((id, code, error, label, label_error) of each vector, the codebooks by part and entry).

    Components are integers floor(1024 * x), vectors are cut into ``parts`` equal parts. A part's codebook starts as that part of the
    ``entries`` vectors with the smallest ids; each round assigns every part to its nearest entry (ties: the smaller number) and moves entries to the
    floors of their parts' means. ``code`` has two hex digits a part, ``error`` the squared distances summed, ``label_error`` its sum over
    equal labels, nulls together.

    Vectors lie in blocks along a Hilbert curve, each with its box and sum. A round lists for each block and part the entries that the box leaves
    possible and compares only these, exactly; codebooks (``parts`` times ``entries`` rows) are all that comes to the driver. Every result is
    that of comparing all with all. On vectors without clusters boxes are wide, and all entries are listed.

    Rows with null vectors or null or non-finite components are dropped; so are vectors whose length is no positive multiple of ``parts`` or
    differs from that of the vector with the smallest id. Repeated ids get a row each, the smaller vector first among equal ids; null ids come last.
    Fewer vectors than ``entries`` make a shorter codebook; no vectors, no rows. Extra columns are left out.
    """
    size = F.size(F.col(f"`{vector}`"))
    rows = kept(df, id, vector, (size > 0) & (size % parts == 0), label)
    order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    rows = stored(rows)
    first = rows.select("id", "v").orderBy(*order).limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    rows = rows.filter(F.size("v") == length)
    start = [r["v"] for r in rows.select("id", "v").orderBy(*order).limit(entries).collect()] or [[0] * length]
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2)
    if first:
        blocks = _blocks(rows, length, parts)
        books = _trained(blocks, books, rounds)
        coded = stored(_coded(blocks, books).select("row.id", F.struct(F.col("row.c0").alias("label")).alias("key"), "code", "error"))
    else:
        coded = rows.select("id", F.struct(F.col("c0").alias("label")).alias("key"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = look_up(coded, sums, "key", "id").select(F.col("id").alias(id), "code", "error", F.col("key.label").alias(label), "label_error")
    return out, books.tolist()
