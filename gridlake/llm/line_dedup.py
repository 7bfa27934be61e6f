"""Repeated runs of lines: suffixes of line-id sequences ranked by prefix doubling; all copies of a run but the first are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numbering import ordered_number
from ..session import cut_lineage
from .arrays import steps

#: Words that a run has at least for its copies to be deleted.
LEAST_WORDS = 50
#: Bits of a position that number the line; the others number the document. A text is an array of less than 2^31 bytes, so no text has more lines.
LINE_BITS = 31


def position(doc: Column, line: Column) -> Column:
    """One BIGINT for a line of a document: lines of a document are neighbours, those of different documents never."""
    return F.shiftleft(doc.cast("long"), LINE_BITS) + line


def line_at(pos: str) -> tuple[Column, Column]:
    """(document, line) of a position."""
    return F.shiftright(pos, LINE_BITS), F.col(pos).bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(key, line, digest, need, back): each line, and how many lines from it on, or up to it, hold ``least`` words (0: all of them do not)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                keys, line, digest, need, back = [], [], [], [], []
                for key, text in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    rows = [] if text is None else text.split(b"\n")
                    words = np.cumsum([0, *(len(r.split()) for r in rows)])
                    reach = np.searchsorted(words, words[:-1] + least)
                    keys += [key] * len(rows)
                    line += range(len(rows))
                    digest += [xxhash.xxh3_128_digest(r) for r in rows]
                    need += np.where(reach <= len(rows), reach - np.arange(len(rows)), 0).tolist()
                    since = np.searchsorted(words, words[1:] - least, "right") - 1
                    back += np.where(words[1:] >= least, np.arange(len(rows)) - since + 1, 0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(line, pa.int64()), pa.array(digest, pa.binary()), pa.array(need, pa.int32()), pa.array(back, pa.int32())],
                    ["key", "line", "digest", "need", "back"])

    return docs.mapInArrow(cut, "key string, line long, digest binary, need int, back int")


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """(pos, rank): suffixes ranked by twice as many lines, of those whose first lines occur elsewhere too.

    The rank is the place of the pair (rank here, rank ``step`` lines on) among all distinct pairs, so ranks keep the order of suffixes.
    Equal pairs are counted before they are sorted.
    """
    ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("after"))
    pairs = cut_lineage(ranks.join(ahead, "pos"))
    names = pairs.groupBy("rank", "after").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("rank", "after")
    named = ordered_number(names, ["rank", "after"], "name")
    return cut_lineage(pairs.join(named, ["rank", "after"]).select("pos", F.col("name").alias("rank")))


def later_copies(lines: DataFrame) -> DataFrame:
    """(pos, length) of windows of lines that an earlier window equals, for lines (pos, digest, need, back).

    A window is as many lines as hold enough words, counted from its first line on or from its last line back; windows of both
    kinds that are later copies cover exactly the lines of all runs with enough words that have an earlier copy.

    Suffixes of the line sequences are ranked by their first 1, 2, 4, ... lines (prefix doubling); only suffixes whose first lines occur
    twice go on. The suffixes that share their first ``length`` lines are an interval of the suffix array, that is those with equal ranks at
    its two halves of a power of two. The first member of the interval stays, the others are later copies.
    """
    twice = lines.groupBy("digest").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("digest")
    ranks = cut_lineage(lines.join(ordered_number(twice, ["digest"], "rank"), "digest").select("pos", "need", "back", "rank"))
    forward = ranks.filter("need > 0").select("pos", F.col("need").alias("length"))
    backward = ranks.filter("back > 0").select((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("length"))
    windows = cut_lineage(forward.unionByName(backward).distinct())
    level, copies, step = ranks.select("pos", "rank"), None, 1
    most = windows.agg(F.max("length")).first()[0] or 0
    while True:
        here = windows.filter((F.col("length") >= step) & (F.col("length") < 2 * step)).join(level, "pos")
        end = level.select(F.col("pos").alias("pos2"), F.col("rank").alias("rank2"))
        whole = here.join(end, F.col("pos") + F.col("length") - step == F.col("pos2")).select("pos", "length", "rank", "rank2")
        first = whole.groupBy("length", "rank", "rank2").agg(F.min("pos").alias("source"), F.count(F.lit(1)).alias("many")).filter("many > 1")
        first = cut_lineage(first)  # a join of two plain shuffles: the rows of a very common run can be split
        later = whole.join(first, ["length", "rank", "rank2"]).filter("pos != source").select("pos", F.col("length").cast("long").alias("length"))
        copies = later if copies is None else copies.unionByName(later)
        if 2 * step > most or level.isEmpty():
            return copies
        level = _doubled(level, step)
        step *= 2


def _covered(runs: DataFrame) -> DataFrame:
    """(doc, spans): the stretches of lines, from and to, that the windows (pos, length) of a document cover, as few as can be.

    Windows are joined where they overlap or touch, not taken apart into lines: texts with few words a line have long windows.
    """
    doc, line = line_at("pos")
    spans = runs.groupBy("pos").agg(F.max("length").alias("length")).select(doc.alias("doc"), line.alias("first"), (line + F.col("length").cast("int")).alias("stop"))
    before = Window.partitionBy("doc").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("fresh", (F.coalesce(F.max("stop").over(before), F.lit(-1)) < F.col("first")).cast("int"))
    parts = fresh.withColumn("part", F.sum("fresh").over(Window.partitionBy("doc").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("doc", "part").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    return joined.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("spans"))


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``df`` with the later copies of repeated line runs deleted from ``text``, and ``_removed``, the numbers of the lines deleted (from 0).

    A run is consecutive lines of one text with ``least`` words or more together; the first copy, by id, then line, stays. Shorter repeated
    lines stay. A line is deleted if it lies in any later copy of a run; a copy may overlap its source. Lines are what ``\\n`` separates.

    Null texts have no lines and stay null; empty texts stay empty. A text of which nothing is left is the empty text; its row stays. Rows
    equal in all columns are copies of each other in some order. A null id comes first. Extra columns are carried along; one named
    ``_removed`` is replaced.
    """
    columns = [c for c in df.columns if c != "_removed"]
    others = [F.col(f"`{c}`") for c in columns if c != text]
    keyed = df.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))  # the text is shuffled once
    keyed = keyed.withColumn("key", F.concat(F.hex(F.xxhash64("row", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "text", "row"))))
    lines = _lines(keyed.select("key", "text"), least).distinct()
    order = keyed.select(F.col(f"row.`{id}`").alias("id"), "key").distinct()
    numbered = cut_lineage(ordered_number(order, ["id", "key"], "doc"))
    placed = lines.join(numbered, "key").select(position(F.col("doc"), F.col("line")).alias("pos"), "digest", "need", "back")
    runs = later_copies(cut_lineage(placed))
    of_doc = _covered(runs).join(numbered, "doc").select("key", "spans")
    again = F.row_number().over(Window.partitionBy("key").orderBy("key")) > 1
    joined = keyed.withColumn("again", again).join(of_doc, "key", "left").select("row", "text", "again", "spans")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                texts, removed = [], []
                for t, again, spans in zip(*(part.column(c).to_pylist() for c in ("text", "again", "spans")), strict=True):
                    rows = [] if t is None else t.split("\n")
                    if again and len((t or "").encode().split()) >= least:
                        spans = [{"first": 0, "stop": len(rows)}]  # an earlier row has all of it
                    drop = {i for x in spans or () for i in range(x["first"], x["stop"])}
                    texts.append("\n".join(r for i, r in enumerate(rows) if i not in drop) if drop else t)
                    removed.append(sorted(drop))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32()))], ["row", "text", "lines"])

    schema = joined.select("row", "text").schema.add("lines", T.ArrayType(T.IntegerType()))
    done = joined.mapInArrow(delete, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in columns], F.col("lines").alias("_removed"))
