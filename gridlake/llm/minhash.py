"""Near duplicates by fast similarity sketches: coordinates in bands find candidates, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import mix, steps
from .chunks import CHUNK_BYTES, batches_of, freeze, written
from .components import connect
from .jaccard_join import _lists, regions_of, shingles
from .shared import stored
from .tiles import cells, compare, measured, opened, rooted

#: Words of a shingle; two texts link from so many hundredths of their union on.
SHINGLE, PERCENT = 2, 80
#: Coordinates of a sketch (a power of two, 256 at most), and those of a band: sets at the threshold meet in a band with 1 - (1 - 0.8**4)**32, all but 5 in 10**8.
COORDINATES, BAND = 128, 4
#: Sets of a bucket from which on it is crowded, and bits of the classes of hashes in which the tokens of crowded buckets are counted.
CROWDED, FREQUENCY_BITS = 256, 16
#: Rows whose sketches are filled at once.
SKETCH_ROWS = 4096

_EMPTY = np.uint64((1 << 64) - 1)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(key: np.ndarray, row: np.ndarray, rows: int, coordinates: int = COORDINATES) -> np.ndarray:
    """A sketch a row, (rows, coordinates), of the sets of 64-bit tokens; equal coordinates of two sketches estimate the Jaccard similarity.

    In round i each token of a row falls into the bin that its i-th hash names, and a bin keeps the least value, those of earlier rounds below
    those of later ones; so a round only fills what is still empty, and a row is done when all its bins are full. From the ``coordinates``-th round on all tokens
    fall into one bin, the next in turn, so that after twice as many rounds none is empty, however small the set. Empty sets stay empty.
    """
    out = np.full(rows * coordinates, _EMPTY, dtype=np.uint64)
    for i in range(2 * coordinates):
        if not len(key):
            break
        h = mix(key ^ _SEEDS[i])
        bin = (h & np.uint64(coordinates - 1)).astype(np.int64) if i < coordinates else i - coordinates
        np.minimum.at(out, row * coordinates + bin, (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9)))
        open_rows = (out.reshape(rows, coordinates) == _EMPTY).any(1)
        left = open_rows[row]
        key, row = key[left], row[left]
    return out.reshape(rows, coordinates)


def bands(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """(rows, bands): a hash of each run of ``band`` coordinates and of its place."""
    grouped = sketch.reshape(len(sketch), -1, band)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_SEEDS[: grouped.shape[1]], grouped.shape[:2]).copy()
        for i in range(band):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, i])
    return out


def _set_hash(key: np.ndarray, row: np.ndarray, rows: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.cumsum(np.bincount(row, minlength=rows))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return mix(total[ends] - total[starts]).view(np.int64)


_SKETCH = "set_a long, set_b long, n int, bands array<long>"


def _sketched(chunk: int, payload: bytes) -> Iterator[pa.Table]:
    """A row for each text of a chunk; ``place`` is that of the text in the chunk."""
    done = 0
    for batch in batches_of(payload):
        for part in steps(batch):
            for start in range(0, part.num_rows, SKETCH_ROWS):
                some = part.slice(start, SKETCH_ROWS)
                rows = some.num_rows
                key, row = shingles(some, size=SHINGLE)
                n = np.bincount(row, minlength=rows)
                full = np.flatnonzero(n)
                found = bands(sketches(key, row, rows)[full])
                yield pa.table({
                    "id": some.column("id"), "chunk": pa.array(np.full(rows, chunk), pa.int64()), "place": pa.array(np.arange(done, done + rows), pa.int32()),
                    "set_a": pa.array(_set_hash(key, row, rows, 0)), "set_b": pa.array(_set_hash(key, row, rows, 0xA5A5A5A55A5A5A5A)),
                    "n": pa.array(n, pa.int32()), "bands": _lists(found.reshape(-1).view(np.int64), np.repeat(full, found.shape[1]), rows)})
                done += rows


def _sets(left: pa.Table, right: pa.Table) -> pa.Table:
    """The full sets of the wanted texts of a chunk."""
    out = pa.table({"uid": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "shared": pa.array([], pa.list_(pa.int64()))})
    if not left.num_rows or not right.num_rows:
        return out
    place, uid = right.column("place").to_numpy(), right.column("uid").to_numpy()
    order = np.argsort(place)
    place, uid, found, done = place[order], uid[order], [out], 0
    for batch in batches_of(left.column("payload")[0].as_buffer()):
        here = (place >= done) & (place < done + batch.num_rows)
        wanted = batch.take(pa.array(place[here] - done))
        ids, done, at = uid[here], done + batch.num_rows, 0
        for part in steps(wanted):
            key, row = shingles(part, size=SHINGLE)
            found.append(pa.table({
                "uid": pa.array(ids[at : at + part.num_rows]), "n": pa.array(np.bincount(row, minlength=part.num_rows), pa.int32()),
                "shared": _lists(key.view(np.int64), row, part.num_rows)}))
            at += part.num_rows
    return pa.concat_tables(found)


def _classes(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many tokens of ``sets`` fall into each class of hashes: 2**FREQUENCY_BITS numbers, whatever the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_classes(batch.column("shared").flatten().to_numpy()), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["class", "n"])

    found = sets.select("shared").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    out[found.column("class").to_numpy()] = found.column("n").to_numpy()
    return out


def _rarest(sets: DataFrame, often: np.ndarray) -> DataFrame:
    """(uid, n, token): of each set the tokens of the rarest classes, so many that two sets that link share one. Any order will do for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n = batch.column("shared").flatten().to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, often[_classes(tokens)], row))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            chosen = place <= (n - -(-PERCENT * n // 100))[row]
            at = row[chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(at)), pa.array(n[at], pa.int32()), pa.array(tokens[order][chosen])], ["uid", "n", "token"])

    return sets.select("uid", "n", "shared").mapInArrow(run, "uid long, n int, token long")


def confirmed(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): confirmed links, enough to connect all sets that share a bucket and link. ``buckets`` has (token, uid, pivot, many).

    Sets of crowded buckets, in which a passage that many texts share has brought together what does not link, are told apart by their rarest tokens:
    two that link share one of them, so the sets with a rare token in common stand for the bucket. Each set is measured against the smallest set of
    such a group, and against the smallest one that it shares any other bucket with, which connects most copies by a link or two each. Where a group then
    still holds more than one component, what is outside of the main one is compared outright (``tiles.compare``).
    """
    crowded = stored(buckets.filter(F.col("many") > CROWDED).select("uid").distinct())
    small = buckets.filter(F.col("many") <= CROWDED).select("token", "uid", "pivot")
    asked = small.filter("uid != pivot").groupBy(F.col("uid").alias("x")).agg(F.min("pivot").alias("y"))
    regions = small
    if not crowded.isEmpty():
        pool = sets.join(crowded, "uid", "left_semi")
        rare = stored(regions_of(stored(_rarest(pool, _frequencies(pool)))).select("token", "uid", "pivot"))
        asked = asked.unionByName(rare.filter("uid != pivot").select(F.col("uid").alias("x"), F.col("pivot").alias("y"))).distinct()
        regions = small.unionByName(rare)
    edges = stored(measured(asked, sets, PERCENT).filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
    left = stored(opened(stored(rooted(regions.select("token", "uid"), edges)), "token"))
    return edges if left.isEmpty() else compare(cells(left), sets, PERCENT, edges)


def group_texts(df: DataFrame, id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept): the smallest id that links lead to, of each text; kept is that text of each component.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set are its distinct shingles of two words, or its one word. Texts link if
    100 * intersection >= 80 * union, confirmed on the full sets. Equal sets are one class, sketched and compared once. A pair at the threshold is found with all but
    5 chances in 10**8, nearer ones more surely; no bucket is cut, crowded ones are split exactly.

    Null texts and texts without words have the empty set, are linked with nothing and kept. Ids are numbers or strings; repeated ids get a row
    each; null ids get a null component, and are not kept, unless a link leads to an id. Extra columns are left out. Shingles are told apart by 64-bit hashes.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    frozen = freeze(rows, "text", chunk_bytes)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, chunk long, place int, {_SKETCH}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                for found in _sketched(chunk, payload.as_buffer()):
                    yield from found.to_batches()

    found = stored(frozen.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()))
    classes = found.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("uid").alias("class"))
    placed = found.select("id", "uid", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    placed = stored(placed.select("id", "n", F.coalesce("class", "uid").alias("class")))  # the empty set is nobody's class

    one = classes.select(F.col("class").alias("uid"))
    tokens = stored(found.join(one, "uid", "left_semi").select("uid", F.explode("bands").alias("token")))
    shared = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("uid").alias("pivot")).filter("many > 1"))
    buckets = stored(tokens.join(shared, "token"))  # two plain shuffles, of which a skewed one can be split
    wanted = found.select("uid", "chunk", "place").join(buckets.select("uid").distinct(), "uid", "left_semi")
    sets = frozen.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_sets, "uid long, n int, shared array<long>")
    linked = confirmed(buckets, written(sets, "uid"))
    group = connect(linked).select(F.col("node").alias("class"), "root")
    placed = placed.join(group, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = stored(placed.groupBy("root").agg(F.min("id").alias("component_id")))  # so that the rows of a large group can be split
    out = placed.join(smallest, "root").select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(f"`{id}`") == F.col("component_id"), F.lit(False)) | (F.col("n_shingles") == 0))
