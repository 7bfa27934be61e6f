"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage
from .arrays import ALNUM, Words, distinct, grams, steps, windows

#: Words of a window, and of a shingle within it.
WINDOW, SHINGLE = 10, 3
#: Most shingles (8 bytes each) that a pass over the documents looks for at once; more take more passes.
KEYS_A_PASS = 1 << 20
#: Most windows (some 200 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def item_windows(items: DataFrame, text: str = "text", id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """(item, words): every window of ``size`` words of an item; a shorter item is one window, an empty one none."""
    listed = items.select(F.col(id).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = listed.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return cut.distinct()


def _shingles(words: np.ndarray, first: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at, row = windows(first, count, n)
    return grams(words, n)[at] if len(at) else np.zeros(0, np.uint64), row


def window_shingles(found: DataFrame) -> DataFrame:
    """(window, words, n, shingle, at): the shingles of each distinct window; ``window`` is its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "window"):
                w = Words(part.column("window"), ALNUM)
                hashes = w.hashes()
                for n in range(1, SHINGLE + 1):
                    # a window of fewer words than a shingle is one shingle
                    rows = np.flatnonzero(w.count == n) if n < SHINGLE else np.flatnonzero(w.count >= n)
                    keys, of = _shingles(hashes, w.first[rows], w.count[rows], n)
                    per = np.maximum(w.count[rows] - n + 1, 0)
                    at = np.arange(len(keys)) - np.repeat(np.cumsum(per) - per, per)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(rows[of])) for c in ("window", "words")), pa.array(w.count[rows][of].astype(np.int32)),
                         pa.array(keys.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(keys), n, np.int32))],
                        ["window", "words", "n", "shingle", "at", "size"])

    distinct = found.select(F.array_join("words", " ").alias("window"), "words").dropDuplicates(["window"])
    return distinct.mapInArrow(cut, "window string, words array<string>, n int, shingle long, at int, size int")


def _passes(keys: DataFrame) -> Iterator[tuple[np.ndarray, list[int], bool]]:
    """The shingles to look for, sorted, in parts of bounded size, the shingle sizes that occur, and whether it is the only part.

    One part at a time is on the driver; who takes more than one writes what it finds before it takes the next.
    """
    keys = keys.distinct()
    parts = -(-keys.count() // KEYS_A_PASS)
    for p in range(parts):
        mine = keys if parts == 1 else keys.filter(F.pmod(F.xxhash64("shingle"), F.lit(parts)) == p)
        rows = mine.toPandas()
        yield np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64)), sorted(set(rows["size"].tolist())), parts == 1


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys


def document_frequency(df: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """(shingle, df): in how many documents each of the shingles ``keys`` occurs; those in none are left out."""
    total = None
    for wanted, sizes, alone in _passes(keys):
        held = df.sparkSession.sparkContext.broadcast(wanted)

        def count(batches: Iterator[pa.RecordBatch], held=held, sizes=sizes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, text):
                    w = Words(part.column(text), ALNUM)
                    hashes = w.hashes()
                    for n in sizes:
                        k, row = _shingles(hashes, w.first, w.count, n)
                        hit = _found(k, held.value)
                        pairs = np.unique(np.stack([k[hit], row[hit].astype(np.uint64)]), axis=1)
                        shingle, df_ = distinct(pairs[0])
                        yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(df_.astype(np.int64))], ["shingle", "df"])

        part = df.select(F.col(text)).mapInArrow(count, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
        if not alone:
            part = cut_lineage(part)
            held.destroy()
        total = part if total is None else total.unionByName(part)
    return total


CANDIDATE = T.ArrayType(T.StructType([
    T.StructField("shingle", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("left", T.IntegerType()),
    T.StructField("context", T.ArrayType(T.StringType()))]))


def candidates(df: DataFrame, text: str, carry: list[str], prefixes: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """(carry..., n_words, found): for each document its prefix shingles, each with the words around it that a window can cover.

    With more shingles than one pass holds, a document has a row for each pass, the first with ``n_words``, the others without.
    """
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("context", pa.list_(pa.string()))]))
    chosen = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_text"))
    schema = chosen.drop("_text").schema.add("n_words", "long").add("found", CANDIDATE)
    total = None
    none = (np.zeros(1, np.uint64), [], True)
    for k, (wanted, sizes, alone) in enumerate(_passes(prefixes) if not prefixes.isEmpty() else [none]):
        held = df.sparkSession.sparkContext.broadcast(wanted)

        def search(batches: Iterator[pa.RecordBatch], held=held, sizes=sizes, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "_text"):
                    w = Words(part.column("_text"), ALNUM)
                    hashes = w.hashes()
                    found = [[] for _ in range(part.num_rows)]
                    for n in sizes:
                        keys, row = _shingles(hashes, w.first, w.count, n)
                        at, _ = windows(w.first, w.count, n)
                        for i in np.flatnonzero(_found(keys, held.value)):
                            r, a = row[i], at[i]
                            start, stop = max(w.first[r], a - reach), min(w.first[r] + w.count[r], a + reach + 1)
                            around = [w.low[w.start[j] : w.end[j]].tobytes().decode("utf-8", "replace") for j in range(start, stop)]
                            found[r].append({"shingle": keys[i : i + 1].view(np.int64)[0], "pos": a - w.first[r], "left": a - start, "context": around})
                    n_words = pa.array(w.count) if k == 0 else pa.nulls(part.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], n_words, pa.array(found, kind)], [*part.schema.names[:-1], "n_words", "found"])

        part = chosen.mapInArrow(search, schema)
        if k:
            part = part.filter(F.size("found") > 0)
        if not alone:
            part = cut_lineage(part)
            held.destroy()
        total = part if total is None else total.unionByName(part)
    return total


def find_items(df: DataFrame, items: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), item: str = "item_id") -> DataFrame:
    """One row for each row of ``df``: ``carry`` columns as the struct ``row``, n_words, n_hit, items (sorted ids of contained items).

    A document's word is hit if it lies in an occurrence of a window: ``WINDOW`` consecutive words of an item, or the whole of
    a shorter item. Containment needs all shingles of a window, so its rarest one is a sufficient prefix: document
    frequencies are counted, each window is looked up by its rarest shingle, those whose rarest shingle occurs nowhere are left
    out, and what is found must lie far enough from either end of the text and is compared word by word.

    Null texts and texts without words have no hits, items without words no windows. A null item id marks words but is not listed.
    Repeated rows get a row each. ``carry`` may be empty.
    """
    found = item_windows(items, text, item)
    parts = cut_lineage(window_shingles(found))
    rarity = document_frequency(df, text, parts.select("shingle", "size"))
    if rarity is None:
        rarity = parts.select("shingle", F.lit(0).cast("long").alias("df")).limit(0)
    ordered = parts.join(rarity, "shingle").groupBy("window").agg(
        F.count(F.lit(1)).alias("present"), F.min(F.struct("df", "shingle", "at", "size", "words", "n")).alias("p"))
    # a window with a shingle that occurs nowhere cannot occur
    whole = ordered.filter(F.col("present") == F.greatest(F.col("p.n") - (SHINGLE - 1), F.lit(1)))
    prefix = cut_lineage(whole.select("window", "p.words", "p.n", "p.shingle", "p.at", "p.size"))

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("row"), F.col(text))
    # equal rows share a key of 128 bits, and their results
    key = F.concat(F.hex(F.xxhash64("row", text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, "row")))
    seen = cut_lineage(candidates(rows.withColumn("uid", key), text, ["row", "uid"], prefix.select("shingle", "size")))
    hits = seen.select("uid", "row", F.explode("found").alias("c")).select("uid", "row", "c.*")
    table = F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix
    start = F.col("left") - F.col("at")
    inside = (start >= 0) & (start + F.col("n") <= F.size("context"))
    same = F.when(inside, F.slice("context", F.when(inside, start + 1).otherwise(1), F.col("n")) == F.col("words"))
    hits = cut_lineage(hits.join(table, "shingle").filter(same).select("uid", "window", "n", (F.col("pos") - F.col("at")).alias("start")).distinct())

    covered = hits.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("w")).distinct()
    n_hit = covered.groupBy("uid").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select(F.array_join("words", " ").alias("window"), "item").filter("item is not null")
    listed = hits.select("uid", "window").distinct().join(named, "window").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = seen.filter("n_words is not null").select("uid", "row", "n_words")
    result = base.join(n_hit, "uid", "left").join(listed, "uid", "left")
    return result.select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
