"""SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrays import places, range_hashes, steps, string_hashes
from .chunks import CHUNK_BYTES, answered, batches_of, bucket_edges, buckets_for, freeze, squeeze, unsqueeze

#: Most pieces of a vocabulary; the piece table is broadcast.
MOST_PIECES = 1 << 17
#: Longest word, in code points, that the fold over its edges takes: its state is the bits of one BIGINT.
FOLD_CHARS = 62
#: Word buckets for each shuffle partition.
BUCKETS_A_PARTITION = 4
_SPACE = "▁"


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces that texts can have, byte pieces, and how a word is cut."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes: tuple[int, ...]
    merges: bool
    size: int

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown(self) -> float:
        """Score of a code point that is no piece: ten below the lowest, as the library has it."""
        return min((s for *_, s in self.pieces), default=0.0) - 10.0

    def scores_by_rank(self) -> list[float]:
        return sorted({s for *_, s in self.pieces}, reverse=True)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank), one row each: at most MOST_PIECES. Ranks begin at 0 for the best score; equal scores share one."""
        rank = {s: r for r, s in enumerate(self.scores_by_rank())}
        return spark.createDataFrame(pa.table({
            "piece": [p.replace(_SPACE, " ") for p, _, _ in self.pieces], "id": pa.array([i for _, i, _ in self.pieces], pa.int32()),
            "rank": pa.array([rank[s] for *_, s in self.pieces], pa.int32())}))


def read_model(path: str) -> Model:
    """A model of type BPE or unigram, with byte fallback, without normalisation: what the public file is."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind = proto.trainer_spec.model_type
    if kind not in (1, 2) or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only BPE and unigram models with byte fallback and no normalisation")
    if not proto.normalizer_spec.add_dummy_prefix or len(proto.pieces) > MOST_PIECES:
        raise ValueError("the model must add a leading space and have a bounded vocabulary")
    normal = tuple((p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4))
    if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p, _, _ in normal):
        raise ValueError("pieces must not go on after a space or hold a line end: words are encoded one by one")
    byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    return Model(normal, tuple(byte[b] for b in range(256)), kind == 2, len(proto.pieces))


class Pieces:
    """The words of a column of texts, each text with a leading space: spaces and what follows them up to the next space or line end,
    spaces before a line end, and line ends. No piece goes over their borders. The piece for a space is a space here."""

    def __init__(self, texts: pa.Array):
        raw = [b"" if t is None else t.replace(b"\xe2\x96\x81", b" ") for t in texts.cast(pa.binary()).to_pylist()]
        filled = [b" " + t for t in raw if t]
        self.data = np.frombuffer(b"\n".join(filled) + b"\n", dtype=np.uint8)
        space, line = self.data == 0x20, self.data == 0x0A
        after_space, after_line = np.concatenate([[False], space[:-1]]), np.concatenate([[True], line[:-1]])
        start = np.flatnonzero(line | after_line | (space & ~after_space))
        end = np.append(start[1:], len(self.data))
        length = np.fromiter(map(len, filled), np.int64, len(filled))
        border = np.cumsum(length + 1) - 1  # the line end after each text is none of its words
        own = np.searchsorted(border, start)
        inside = start != border[np.minimum(own, len(border) - 1)] if len(border) else np.zeros(len(start), dtype=bool)
        self.start, self.end = start[inside], end[inside]
        #: Words of each text.
        self.count = np.zeros(len(raw), dtype=np.int64)
        self.count[np.flatnonzero([bool(t) for t in raw])] = np.bincount(own[inside], minlength=len(filled)) if filled else 0

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)

    def strings(self, which: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode("utf-8") for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def words_of(text: str | None) -> list[str]:
    """Words of one text."""
    p = Pieces(pa.array([text], pa.string()))
    return p.strings(np.arange(len(p.start)))


#: Places and ids of an edge in its BIGINT: rank, from, to, id + 1, from the highest bits down.
_RANK, _FROM, _TO, _ID = (46, (1 << 17) - 1), (36, 63), (26, 63), (0, (1 << 26) - 1)


def _part(edge: Column, which: tuple[int, int]) -> Column:
    return F.shiftright(edge, which[0]).bitwiseAND(F.lit(which[1]).cast("long"))


def lattice(words: DataFrame, keys: list[str], pieces: DataFrame, longest: int) -> DataFrame:
    """``words`` (keys..., word) with ``edges``: an array of all pieces that lie in the word, each packed into a BIGINT.

    Substrings of up to ``longest`` code points are exploded and joined to the piece table; single code points that are no piece
    get id -1 and the lowest rank. If ``words`` is hash-partitioned by some of ``keys``, no row moves. ``mark``, a hash of the word, is only
    there to make the grouping's comparisons cheap.
    """
    n = F.length("word")
    starts = words.select(*keys, "word", F.xxhash64("word").alias("mark"), F.explode(F.sequence(F.lit(0), n - 1)).alias("from"))
    spans = starts.select("*", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + longest, n))).alias("to"))
    cut = spans.select("*", F.substring(F.col("word"), F.col("from") + 1, F.col("to") - F.col("from")).alias("piece"))
    met = cut.join(F.broadcast(pieces.select("piece", "id", "rank")), "piece", "left").filter(
        F.col("id").isNotNull() | (F.col("to") - F.col("from") == 1))
    put = lambda c, which: F.shiftleft(c.cast("long"), which[0])
    edge = put(F.coalesce("rank", F.lit(_RANK[1])), _RANK).bitwiseOR(put(F.col("from"), _FROM)).bitwiseOR(put(F.col("to"), _TO)).bitwiseOR(
        (F.coalesce("id", F.lit(-1)) + 1).cast("long"))
    return met.select("mark", *keys, "word", edge.alias("edge")).groupBy("mark", *keys, "word").agg(F.collect_list("edge").alias("edges")).drop("mark")


def _bit(a: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), a.cast("int"))


def _between(edge: Column) -> Column:
    """Bits of the borders inside an edge."""
    return _bit(_part(edge, _TO)) - F.shiftleft(_bit(_part(edge, _FROM)), 1)


def _ends(edge: Column) -> Column:
    return _bit(_part(edge, _FROM)).bitwiseOR(_bit(_part(edge, _TO)))


def _in_order(edges: Column) -> Column:
    """Edges by where they begin, without their rank."""
    low = (1 << _RANK[0]) - 1
    return F.sort_array(F.transform(edges, lambda e: e.bitwiseAND(F.lit(low))))


def fold_merges(edges: Column, n: Column) -> Column:
    """Edges of a BPE segmentation, in order: pieces are taken best first, leftmost first, wherever two neighbours make one.

    The state is the set of borders between pieces, as bits. A merge never makes a better piece possible that could have been made
    before, so one pass in the order of scores does the merges in the library's order.
    """
    def open_at(borders: Column, e: Column) -> Column:
        return F.bitwise_not(borders).bitwiseAND(_ends(e)) == 0

    def step(borders: Column, e: Column) -> Column:
        merges = open_at(borders, e) & (F.bit_count(borders.bitwiseAND(_between(e))) == 1)  # the first test fails for most edges
        return F.when(merges, borders.bitwiseAND(F.bitwise_not(_between(e)))).otherwise(borders)

    longer = F.filter(edges, lambda e: _part(e, _TO) - _part(e, _FROM) > 1)
    borders = F.aggregate(F.sort_array(longer), _bit(n + 1) - 1, step)
    return F.transform(F.array(borders), lambda b: _in_order(F.filter(
        edges, lambda e: open_at(b, e) & (b.bitwiseAND(_between(e)) == 0))))[0]


def fold_best_path(edges: Column, n: Column, scores: Column, unknown: float) -> Column:
    """Edges of the best path through the lattice, in order: Viterbi over the ends of edges, then back along the best ones.

    ``scores`` has the score of each rank; code points that are no piece cost ``unknown``.
    """
    score = lambda e: F.coalesce(F.get(scores, _part(e, _RANK).cast("int")), F.lit(unknown))
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("edge"))

    def step(best: Column, end: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: _part(e, _TO) == end), lambda e: F.struct(
            (F.get(best, _part(e, _FROM).cast("int"))["total"] + score(e)).alias("total"), e.alias("edge")))
        return F.array_append(best, F.array_max(into))

    start = F.struct(F.array().cast("array<bigint>").alias("path"), n.cast("int").alias("at"))

    def back(best: Column) -> Column:
        def walk(state: Column, _: Column) -> Column:
            e = F.get(best, state["at"])["edge"]
            return F.when(state["at"] > 0, F.struct(F.array_prepend(state["path"], e).alias("path"), _part(e, _FROM).cast("int").alias("at"))).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), n), start, walk, lambda s: s["path"])

    best = F.aggregate(F.sequence(F.lit(1), n), F.array(none), step)
    return _in_order(F.transform(F.array(best), back)[0])


def segment(words: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``words`` (keys..., word) with ``cut``: the pieces in order, each as where it ends * 2^26 + id + 1 (id -1: a code point that is no piece).

    BPE models merge as their library does; unigram models take the best path.
    """
    edges = lattice(words, keys, model.table(words.sparkSession), model.longest)
    n = F.length("word")
    if model.merges:
        chosen = fold_merges(F.col("edges"), n)
    else:
        scores = F.lit(model.scores_by_rank())
        chosen = fold_best_path(F.col("edges"), n, scores, model.unknown)
    return edges.select(*keys, "word", F.transform(chosen, lambda e: e.bitwiseAND(F.lit((1 << 32) - 1))).alias("cut"))


def merge_long(word: str, score: dict[str, float], longest: int) -> list[int]:
    """Where the pieces of a long word end: the same fold with a list for the borders."""
    n = len(word)
    edges = sorted((-score[p], i, j) for i in range(n) for j in range(i + 2, min(n, i + longest) + 1) if (p := word[i:j]) in score)
    border = bytearray(b"\x01" * (n + 1))
    for _, i, j in edges:
        if border[i] and border[j] and border.count(1, i + 1, j) == 1:
            border[border.index(1, i + 1)] = 0
    return [k for k in range(1, n + 1) if border[k]]


def best_path_long(word: str, score: dict[str, float], longest: int, unknown: float) -> list[int]:
    n = len(word)
    best = [(0.0, 0)] + [(-float("inf"), 0)] * n
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = word[i:j]
            if p in score or j - i == 1:
                best[j] = max(best[j], (best[i][0] + score.get(p, unknown), i))
    ends, j = [], n
    while j:
        ends.append(j)
        j = best[j][1]
    return ends[::-1]


def _ask(payload: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bucket borders, hashes, words) of the distinct words of a chunk, by hash."""
    hashes, found = [], []
    for batch in batches_of(payload):
        for part in steps(batch):
            p = Pieces(part.column("text"))
            keys = p.hashes()
            order = np.argsort(keys)
            first = order[np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))] if len(keys) else order
            hashes.append(keys[first])
            found += p.strings(first)
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    fresh = order[np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))] if len(every) else order
    keys = every[fresh]
    return bucket_edges(keys, buckets, 64), keys, [found[i] for i in fresh.tolist()]


def _requests(frozen: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words): the distinct words of each chunk, dealt by ranges of their hashes, packed; they are answered by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                edge, _, words = _ask(payload.as_buffer(), buckets)
                packed = [_pack(words[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(buckets), pa.int32()), pa.array([chunk] * buckets, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "chunk", "words"])

    return frozen.mapInArrow(run, "bucket int, chunk long, words binary")


def _all_words(asked: pa.Table) -> tuple[pa.StringArray, np.ndarray, list[int]]:
    """(words asked for, their hashes, how many each chunk asks for)."""
    lists = [_unpack(data) for data in asked.column("words").to_pylist()]
    every = pa.array([w for words in lists for w in words], pa.string())
    return every, string_hashes(every), [len(words) for words in lists]


def _distinct_words(asked: pa.Table) -> pa.Table:
    words, hashes, _ = _all_words(asked)
    _, first = np.unique(hashes, return_index=True)
    return pa.table({"bucket": pa.array(np.full(len(first), asked.column("bucket")[0].as_py(), np.int32)), "word": words.take(pa.array(first))})


def encode(df: DataFrame, model: Model, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``df`` without ``text``, with ``ids``: the token ids of the whole text, as the model's library gives them.

    Each chunk of texts asks for its distinct words; over all, each distinct word is cut once: its substrings are joined to the piece
    table, the edges are grouped by word, and folded by a higher-order aggregate. The cuts go back to the chunks that asked, and the texts
    are put together there. Words of over FOLD_CHARS code points are folded in the same order by a loop. Code points that are no piece
    become byte pieces.

    Null and empty texts have no tokens. Repeated rows get a row each; extra columns are carried along, one named ``ids`` is replaced.
    Words are told apart by 64-bit hashes.
    """
    kept = [c for c in df.columns if c not in (text, "ids")]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text}`").alias("text"))
    frozen = freeze(packed, "text", chunk_bytes)
    # small buckets, as a word has many edges; their number is kept, so that asking, cutting and answering share one partitioning
    buckets = BUCKETS_A_PARTITION * buckets_for(df)
    # a task for each bucket: by a hash of its number a third of the tasks had none, and others several, whose edges they all hold at once
    asked = _requests(frozen, buckets).repartitionById(buckets, F.col("bucket"))
    words = asked.groupBy("bucket").applyInArrow(_distinct_words, "bucket int, word string")
    cut = segment(words.filter(F.length("word") <= FOLD_CHARS).repartitionById(buckets, F.col("bucket")), ["bucket"], model)
    score = {p.replace(_SPACE, " "): s for p, _, s in model.pieces}
    id_of = {p.replace(_SPACE, " "): i for p, i, _ in model.pieces}
    held = df.sparkSession.sparkContext.broadcast((score, id_of))
    merges, byte, longest, unknown = model.merges, model.bytes, model.longest, model.unknown

    def ids_of(word: str, ends: list[int]) -> list[int]:
        ids = []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            known = held.value[1].get(word[a:b])
            ids += [known] if known is not None else [byte[x] for x in word[a:b].encode()]
        return ids

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids of the words asked for: those cut by the fold, and long ones."""
        words, hashes, sizes = _all_words(left)
        known, cuts = right.column("word").combine_chunks(), right.column("cut").combine_chunks()
        size, flat = np.diff(cuts.offsets.to_numpy()).astype(np.int64), cuts.flatten().to_numpy()
        ids = (flat & ((1 << 26) - 1)).astype(np.int64) - 1
        first = np.cumsum(size) - size
        odd = np.unique(np.repeat(np.arange(len(size)), size)[ids < 0])  # words with code points that are no piece
        extra = [ids_of(known[i].as_py(), (flat[first[i] : first[i] + size[i]] >> 26).tolist()) for i in odd.tolist()]
        order = np.argsort(keys := string_hashes(known)) if len(known) else np.zeros(0, np.int64)
        distinct, at = np.unique(hashes, return_inverse=True)
        where = np.searchsorted(keys[order], distinct) if len(known) else np.zeros(len(distinct), np.int64)
        hit = np.zeros(len(distinct), dtype=bool)
        if len(known):
            hit = keys[order][np.minimum(where, len(known) - 1)] == distinct
        _, sample = np.unique(at, return_index=True)
        for k in np.flatnonzero(~hit).tolist():  # too long for the fold
            word = words[int(sample[k])].as_py()
            extra.append(ids_of(word, merge_long(word, held.value[0], longest) if merges else best_path_long(word, held.value[0], longest, unknown)))
        more = np.fromiter(map(len, extra), np.int64, len(extra))
        all_ids = np.concatenate([ids, np.fromiter((i for e in extra for i in e), np.int64, int(more.sum()))])
        all_size, all_first = np.concatenate([size, more]), np.concatenate([first, len(ids) + np.cumsum(more) - more])
        choice = np.zeros(len(distinct), dtype=np.int64)
        choice[hit] = order[where[hit]] if len(known) else 0
        choice[~hit] = len(size) + len(odd) + np.arange(int((~hit).sum()))
        swap = np.arange(len(all_size))
        swap[odd] = len(size) + np.arange(len(odd))
        choice = swap[choice][at]
        told, done = [], 0
        for k in sizes:
            mine = choice[done : done + k][np.argsort(hashes[done : done + k])]
            n = all_size[mine]
            tokens = all_ids[np.repeat(all_first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            told.append((squeeze(n.astype(np.int32)), squeeze(tokens.astype(np.int32))))
            done += k
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "n": pa.array([t[0] for t in told], pa.binary()), "ids": pa.array([t[1] for t in told], pa.binary())})

    cut = cut.select(F.col("bucket").alias("of_bucket"), "word", "cut")
    told = asked.groupBy("bucket").cogroup(cut.groupBy("of_bucket")).applyInArrow(answer, "chunk long, bucket int, n binary, ids binary")
    schema = packed.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))

    def put_together(payload: bytes, answers: pa.Table) -> pa.Table:
        size = np.concatenate([unsqueeze(x.as_py(), np.int32) for x in answers.column("n")]).astype(np.int64)
        flat = np.concatenate([unsqueeze(x.as_py(), np.int32) for x in answers.column("ids")])
        first = np.cumsum(size) - size
        parts = [part for batch in batches_of(payload) for part in steps(batch)]
        found = [(p.count, p.hashes()) for p in (Pieces(part.column("text")) for part in parts)]
        _, at = places(np.concatenate([h for _, h in found]))
        out, done = [], 0
        for part, (count, h) in zip(parts, found, strict=True):
            mine = at[done : done + len(h)]
            done += len(h)
            n = size[mine]
            total = np.concatenate([[0], np.cumsum(n)])
            tokens = flat[np.repeat(first[mine] - total[:-1], n) + np.arange(total[-1])]
            offsets = total[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
            out.append(pa.table({"row": part.column("row"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))}))
        return pa.concat_tables(out)

    done = answered(frozen, told, put_together, schema)
    return done.select(*[F.col(f"row.`{c}`") for c in kept], "ids")


def _pack(words: list[str]) -> bytes:
    """Sorted words in one compressed text, a line each; no word but the line end itself, which is the empty line, holds one."""
    return zstandard.compress("\n".join(w if w != "\n" else "" for w in sorted(words)).encode(), 3) if words else b""


def _unpack(data: bytes) -> list[str]:
    return [w or "\n" for w in zstandard.decompress(data).decode().split("\n")] if data else []


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` without ``ids``, with ``text``: the pieces put together, without the leading space.

    Each id is looked up in the piece table, one array that all rows share, and the pieces are joined. Byte pieces become bytes; texts with
    bytes beyond ASCII are joined as bytes, and bytes that are no UTF-8 become U+FFFD. Control pieces and ids outside the
    vocabulary are nothing. A null or empty list is the empty text. Literal U+2581 was encoded as a space and is decoded as one.
    """
    parts = [b""] * model.size
    for p, i, _ in model.pieces:
        parts[i] = p.replace(_SPACE, " ").encode()
    for b, i in enumerate(model.bytes):
        parts[i] = bytes([b])
    high = [False] * model.size
    for i in model.bytes[0x80:]:
        high[i] = True
    rows = df.sparkSession.createDataFrame(pa.table({
        "id": pa.array(range(model.size), pa.int32()), "part": pa.array(parts, pa.binary()), "high": pa.array(high)}))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("id", "part", "high"))).alias("t")).select(F.struct(
        F.transform("t", lambda p: F.when(p["high"], F.lit("")).otherwise(p["part"].cast("string"))).alias("plain"),
        F.transform("t", lambda p: F.hex(p["part"])).alias("hex"), F.transform("t", lambda p: p["high"]).alias("high")).alias("t"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ids, text)]
    held = df.select(F.struct(*kept or [F.lit(0).alias("none")]).alias("row"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("i"))
    held = held.withColumn("t", listed.scalar())

    def joined(v: Column) -> Column:
        i, t = v["i"], v["t"]
        look = lambda kind: F.array_join(F.transform(i, lambda x: F.get(t[kind], x)), "")
        raw = F.make_valid_utf8(F.unhex(look("hex")).cast("string"))
        return F.when(F.exists(i, lambda x: F.coalesce(F.get(t["high"], x), F.lit(False))), raw).otherwise(look("plain"))

    whole = F.transform(F.array(F.struct("i", "t")), joined)[0]
    done = held.select("row", whole.alias("w")).select("row", F.when(F.col("w").startswith(" "), F.expr("substring(w, 2)")).otherwise(F.col("w")).alias("w"))
    return done.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in (ids, text)], F.col("w").alias(text))
