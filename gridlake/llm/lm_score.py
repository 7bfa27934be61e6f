"""Language-model scores: smoothed n-grams as a weighted automaton with failure arcs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import SPACED, Words, distinct, mix, places, steps
from .chunks import CHUNK_BYTES, answered, batches_of, bucket_edges, buckets_for, freeze, requests, squeeze, unsqueeze

#: Documents whose CRC-32 of the id, as text, leaves HELD_OUT modulo FOLDS are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Weight of the lower order in a state, in counts: a state seen n times leaves MASS/(n+MASS) to its failure arc.
MASS = 100.0

_END = np.uint64(0x5EED0F7E5EED0F7E)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _held_out(id: object) -> bool:
    return id is not None and zlib.crc32(str(id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """Hashes of a chunk's tokens in order: the words of each text, then its end. ``pair`` is (state, token), the state being the token before."""

    def __init__(self, payload: bytes):
        token, size, learn, self.ids = [], [], [], []
        for batch in batches_of(payload):
            ids = batch.column("id").to_pylist()
            for part in steps(batch, "text"):
                w = Words(part.column("text"), SPACED)
                out = np.full(len(w.row) + len(w.count), _END, dtype=np.uint64)
                out[np.arange(len(w.row)) + w.row] = w.hashes()
                token.append(out)
                size.append(w.count + 1)
            learn.append(np.array([not _held_out(i) for i in ids], dtype=bool))
            self.ids += ids
        self.token, self.size = np.concatenate(token), np.concatenate(size)
        self.learn = np.concatenate(learn)
        self.first = np.cumsum(self.size) - self.size
        # the end of a text is the state in which the next one begins
        with np.errstate(over="ignore"):
            self.pair = mix(np.concatenate([[_END], self.token[:-1]]) * _PAIR + self.token)

    def asked(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, sorted; how often the learned texts have each)."""
        every, _ = distinct(keys)
        known, n = distinct(keys[np.repeat(self.learn, self.size)])
        counts = np.zeros(len(every), dtype=np.uint32)
        counts[np.searchsorted(every, known)] = n
        return every, counts


_REQUEST = "chunk long, bucket int, token binary, token_n binary, pair binary, pair_n binary"
_ANSWER = "chunk long, bucket int, token_n binary, pair_n binary, total long, kinds long"


def _ask(buckets: int):
    def ask(payload: bytes) -> Iterator[dict]:
        t = Tokens(payload)
        (tokens, token_n), (pairs, pair_n) = t.asked(t.token), t.asked(t.pair)
        a, b = bucket_edges(tokens, buckets, 64), bucket_edges(pairs, buckets, 64)
        for i in range(buckets):
            x, y = slice(a[i], a[i + 1]), slice(b[i], b[i + 1])
            yield {"bucket": i, "token": tokens[x].tobytes(), "token_n": squeeze(token_n[x]), "pair": pairs[y].tobytes(), "pair_n": squeeze(pair_n[y])}

    return ask


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """(each asker's keys' totals over all, sum of totals, keys with any)."""
    every, at = places(np.concatenate(keys))
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    return np.split(total[at], np.cumsum([len(k) for k in keys])[:-1]), int(total.sum()), int((total > 0).sum())


def _answer(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    token, total, kinds = _summed([np.frombuffer(r["token"], np.uint64) for r in rows], [unsqueeze(r["token_n"], np.uint32) for r in rows])
    pair, _, _ = _summed([np.frombuffer(r["pair"], np.uint64) for r in rows], [unsqueeze(r["pair_n"], np.uint32) for r in rows])
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "token_n": pa.array([squeeze(x) for x in token], pa.binary()), "pair_n": pa.array([squeeze(x) for x in pair], pa.binary()),
        "total": pa.array([total] * len(rows), pa.int64()), "kinds": pa.array([kinds] * len(rows), pa.int64())})


def walk(token_n: np.ndarray, state_n: np.ndarray, pair_n: np.ndarray, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the add-one share, log10 weight of the arcs taken) of each token, left to right.

    A token that the state has an arc for takes it. Else the failure arc leads, at its weight, to the empty state, which has an arc for every
    token, unknown ones included. Either way the token is the next state; a state never seen has a failure arc of weight one.
    """
    low = (token_n + 1) / (total + kinds + 1)
    arc = (pair_n + MASS * low) / (state_n + MASS)
    failure = MASS / (state_n + MASS)
    return np.log10(low), np.where(pair_n > 0, np.log10(arc), np.log10(failure) + np.log10(low))


def _score(payload: bytes, answers: pa.Table) -> pa.Table:
    t = Tokens(payload)
    rows = answers.to_pylist()
    total, kinds = sum(r["total"] for r in rows), sum(r["kinds"] for r in rows)
    counts = {}
    for kind, keys in (("token", t.token), ("pair", t.pair)):
        told = np.concatenate([unsqueeze(r[f"{kind}_n"], np.int64) for r in rows])
        counts[kind] = told[places(keys)[1]]
    ends = counts["token"][t.first[0] + t.size[0] - 1]  # as many texts begin as end
    state_n = np.concatenate([[ends], counts["token"][:-1]])
    low, arcs = walk(counts["token"], state_n, counts["pair"], total, kinds)
    of_text = lambda x: np.add.reduceat(x, t.first)
    return pa.table({
        "id": pa.array(t.ids, pa.int64()), "held_out": pa.array(~t.learn), "n_tokens": pa.array(t.size, pa.int64()),
        "n_known": pa.array(of_text((counts["token"] > 0).astype(np.int64)), pa.int64()),
        "train_tokens": pa.array(np.full(len(t.size), total), pa.int64()), "base_score": pa.array(of_text(low)), "score": pa.array(of_text(arcs))})


def score_texts(df: DataFrame, id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text; scores are log10 probabilities.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then an end. All documents outside the held-out fold are learned from:
    their word and word-pair counts make the states and arcs of a backoff automaton of order two. Chunks of texts ask the hash buckets
    for the counts of their distinct words and pairs, each with its own count, so counting and look-up are one shuffle; with the answers
    each text is walked from left to right. A frequent word is one entry a chunk.

    Null and empty texts are an end alone. A null id is learned from. Repeated rows count, and get a row, each. Extra columns are
    left out. Words are told apart by 64-bit hashes.
    """
    frozen = freeze(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "text", chunk_bytes)
    asked = requests(frozen, _ask(buckets_for(df)), _REQUEST)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    out = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(frozen, answers, _score, out).withColumnRenamed("id", id)
