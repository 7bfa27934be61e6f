"""Exact Jaccard join of texts on word shingles, as a join in the metric space of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrays import SPACED, Words, distinct, grams, mix, places, steps, windows
from .chunks import CHUNK_BYTES, answered, batches_of, bucket_edges, buckets_for, freeze, requests, squeeze, unsqueeze, written
from .components import connect
from .shared import look_up
from .tiles import cells, compare, measured, opened, rooted

#: Words of a shingle; two texts link from so many hundredths of their union on.
SHINGLE, PERCENT = 5, 75
#: Pivots that a region is joined with before the pairs left in it are compared outright.
PIVOT_ROUNDS = 1

_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)


def shingles(part: pa.RecordBatch, text: str = "text", size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle, row) without repetition, sorted by row; a text of fewer words is one shingle, one without words has none."""
    w = Words(part.column(text), SPACED)
    hashes = w.hashes()
    keys, rows = [], []
    at, row = windows(w.first, w.count, size)
    if len(at):
        keys.append(grams(hashes, size)[at])
        rows.append(row)
    for n in range(1, size):
        short = np.flatnonzero(w.count == n)
        if len(short):
            keys.append(grams(hashes, n)[w.first[short]])
            rows.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16 if part.num_rows < 1 << 16 else np.int64), kind="stable")]  # 16 bits: a radix sort
    key, row = key[order], row[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[fresh], row[fresh]


def _ask(buckets: int):
    def ask(payload: bytes) -> Iterator[dict]:
        every = [shingles(part)[0] >> np.uint64(32) for batch in batches_of(payload) for part in steps(batch)]
        keys, n = distinct(np.concatenate(every).astype(np.uint32))
        edge = bucket_edges(keys, buckets, 32)
        for b in range(buckets):
            mine = keys[edge[b] : edge[b + 1]]
            yield {"bucket": b, "gaps": squeeze(np.diff(mine, prepend=np.uint32(0))), "n": squeeze(n[edge[b] : edge[b + 1]].astype(np.uint32))}

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """For each shingle class of each chunk how many documents have it, in steps: 1, 2, 3 ... 15, then sixteen to the doubling."""
    rows = asked.to_pylist()
    keys = [np.cumsum(unsqueeze(r["gaps"], np.uint32), dtype=np.uint32) for r in rows]
    every, at = places(np.concatenate(keys))
    total = np.bincount(at, weights=np.concatenate([unsqueeze(r["n"], np.uint32) for r in rows]), minlength=len(every))
    step = np.where(total < 16, total, np.minimum(255, 16 * np.log2(np.maximum(total, 1)) - 48)).astype(np.uint8)
    told = np.split(step[at], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "step": pa.array([squeeze(x) for x in told], pa.binary())})


#: ``shared`` are the shingles that other documents have too, rarest first; its first ``n_prefix`` are those of the prefix.
_SETS = "set_a long, set_b long, n int, n_prefix int, shared array<long>"


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _prefixes(payload: bytes, answers: pa.Table) -> pa.Table:
    parts = [(part, *shingles(part)) for batch in batches_of(payload) for part in steps(batch)]
    _, at = places(np.concatenate([key >> np.uint64(32) for _, key, _ in parts]).astype(np.uint32))
    told = np.concatenate([unsqueeze(s.as_py(), np.uint8) for s in answers.column("step").combine_chunks()])[at]
    out, done = [], 0
    for part, key, row in parts:
        rows = part.num_rows
        often = told[done : done + len(key)]
        done += len(key)
        n = np.bincount(row, minlength=rows)
        # by row, then rarity, then key: rows hold their keys in order already, and stable sorts keep it
        order = np.argsort(often, kind="stable")
        order = order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]
        key, often, row = key[order], often[order], row[order]
        place = np.arange(len(key)) - (np.cumsum(n) - n)[row]
        twice = often > 1  # else no other document has it
        inside = twice & (place <= n[row] - -(-PERCENT * n[row] // 100))
        wanted = np.bincount(row[inside], minlength=rows) > 0
        shared = twice & wanted[row]
        sums = []
        with np.errstate(over="ignore"):
            for salted in (mix(key), mix(key ^ _OTHER)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
                ends = np.cumsum(n)
                sums.append(mix(total[ends] - total[ends - n]).view(np.int64))
        out.append(pa.table({
            "id": part.column("id"), "set_a": pa.array(sums[0]), "set_b": pa.array(sums[1]), "n": pa.array(n, pa.int32()),
            "n_prefix": pa.array(np.bincount(row[inside], minlength=rows), pa.int32()), "shared": _lists(key[shared].view(np.int64), row[shared], rows)}))
    return pa.concat_tables(out)


def regions_of(postings: DataFrame) -> DataFrame:
    """Postings with the pivot of their region: its smallest set. A region of one set is joined with nothing and goes."""
    found = postings.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("uid").alias("pivot")).filter("many > 1")
    return postings.join(found.select("token", "pivot"), "token")


def links(sets: DataFrame, postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): links between sets, enough of them to connect whatever links connect.

    Sets that link share a token of both prefixes (that part of their shingles, the rarest, which they may lack: a quarter at 75 percent), so each prefix token is a
    region. The region's pivot is its smallest id, which is the same in most regions of a group of copies. All distances to
    pivots are measured. Sets within the radius of the pivot are connected by it. Two sets can link only if their distances to the
    pivot differ by the radius or less (triangle inequality) and their sizes allow it: the window of a region's open sets
    says which others stay in it. After PIVOT_ROUNDS, which is one (with more, what is left of a region would be joined in the same way with its
    next pivot), the regions with the same main component are cells, and what is not connected in them is compared outright, in tiles of bounded
    size (``tiles.compare``).
    """
    regions = cut_lineage(regions_of(postings))
    edges, slack = None, 1 - percent / 100 + 1e-9  # the radius, and room for rounding
    for _ in range(PIVOT_ROUNDS):
        regions = regions.select("token", "uid", "n", "pivot")
        asked = regions.filter("uid != pivot").select(F.col("uid").alias("x"), F.col("pivot").alias("y")).distinct()
        met = cut_lineage(measured(asked, sets, percent))
        new = met.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        edges = cut_lineage(new if edges is None else edges.unionByName(new))
        # the pivot has met all of its region and leaves it
        left = regions.join(met.select(F.col("x").alias("uid"), F.col("y").alias("pivot"), "distance"), ["uid", "pivot"]).drop("pivot")
        marked = cut_lineage(opened(cut_lineage(rooted(left, edges)), "token"))
        # a set out of reach of all open sets of its region, by its distance to the pivot or its size, has no link left there
        reach = marked.filter("open").groupBy("token").agg(
            F.min("uid").alias("pivot"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.min("n").alias("least"), F.max("n").alias("most"))
        window = (F.col("distance") >= F.col("near") - slack) & (F.col("distance") <= F.col("far") + slack)
        sizes = (100 * F.col("n") >= percent * F.col("least")) & (percent * F.col("n") <= 100 * F.col("most"))
        regions = cut_lineage(look_up(marked, reach, "token", "uid").filter(F.col("open") | (window & sizes)).drop("near", "far", "least", "most"))
        if regions.isEmpty():
            return edges
    return compare(cells(regions), sets, percent, edges)


def group_texts(df: DataFrame, id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links lead to, of each text.

    Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set are its distinct shingles of five words, or all its words if it has
    fewer. Texts link if 100 * intersection >= 75 * union. Equal sets are one class, compared once; shingles that one
    document alone has are never shuffled one by one.

    Null texts and texts without words have the empty set and are linked with nothing. Ids are numbers or strings; repeated ids get a row
    each; null ids get a null component unless a link leads to an id. Extra columns are left out. Shingles are told apart by 64-bit hashes.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    frozen = freeze(rows, "text", chunk_bytes)
    asked = requests(frozen, _ask(buckets_for(df)), "chunk long, bucket int, gaps binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, step binary")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_SETS}"
    found = written(answered(frozen, answers, _prefixes, schema).withColumn("uid", F.monotonically_increasing_id()), "uid")

    classes = found.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("uid").alias("class"))
    rows = found.select("id", "uid", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    rows = cut_lineage(rows.select("id", "n", F.coalesce("class", "uid").alias("class")))  # the empty set is nobody's class
    used = rows.select(F.col("class").alias("uid")).distinct()
    sets = found.filter("n_prefix > 0").select("uid", "n", "n_prefix", "shared")
    postings = sets.join(used, "uid", "left_semi").select("uid", "n", F.explode(F.slice("shared", F.lit(1), F.col("n_prefix"))).alias("token"))
    linked = links(sets, cut_lineage(postings))
    group = connect(linked).select(F.col("node").alias("class"), "root")
    placed = rows.join(group, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = cut_lineage(placed.groupBy("root").agg(F.min("id").alias("component_id")))  # so that the rows of a large group can be split
    return placed.join(smallest, "root").select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), "component_id")
