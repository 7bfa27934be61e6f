"""Vectorised words and n-grams over Arrow string columns, for the functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step looks at, so that its work arrays stay in the tens of MB.
STEP_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes: all but space and 0x09-0x0D.
SPACED = ~_BLANK
#: Word bytes: digits, lower-case ASCII letters, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each; a longer text is a slice of its own."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; how often each occurs). Sorting is far faster here than hashing."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; the place of each key among them)."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(fresh) - 1
    return ranked[fresh], out


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: its bytes as a polynomial, from sums over the whole buffer, then mixed with its length."""
    with np.errstate(over="ignore"):
        n = len(data)
        power = np.full(n + 1, _PRIME, dtype=np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        back = np.full(n + 1, np.uint64(pow(int(_PRIME), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def string_hashes(strings: pa.StringArray) -> np.ndarray:
    """``range_hashes`` of an array of strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return range_hashes(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


class Words:
    """The words of a column of texts: byte ranges, the row of each, and 64-bit hashes.

    A null text has no words. ``low`` holds the bytes with A-Z lower-cased; a word never spans two texts.
    """

    def __init__(self, texts: pa.Array, kinds: np.ndarray, lower: bool = True):
        raw = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b" ".join(raw), dtype=np.uint8)  # a space ends a word in either kind
        self.low = _LOWER[data] if lower else data
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        #: First byte of each text.
        self.base = np.cumsum(lengths + 1) - lengths - 1
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = kinds[self.low]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.row = np.searchsorted(self.base, self.start, "right") - 1
        #: Words of each text, and the place of its first word.
        self.count = np.bincount(self.row, minlength=len(raw)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return range_hashes(self.low, self.start, self.end)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` neighbouring words; windows over the border of two texts are for the caller to drop."""
    with np.errstate(over="ignore"):
        size = max(0, len(words) - n + 1)
        out = np.zeros(size, dtype=np.uint64)
        for i in range(n):
            out = out * _PRIME + words[i : i + size]
        return mix(out + np.uint64(n))


def windows(first: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each window of ``n`` words that lies in one text, row of that text)."""
    per = np.maximum(count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), per)
    before = np.cumsum(per) - per
    return np.repeat(first - before, per) + np.arange(per.sum()), row
