"""Secrets in texts: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import steps

#: Kinds in the order in which ties are listed, key words, patterns, least lengths.
KINDS = ("assign", "access", "hex", "code_token", "package_token", "extended_key")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "code_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package_token": ("npm_",),
    "extended_key": ("xprv",),
}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CODE_TOKEN = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
PACKAGE_TOKEN = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
EXTENDED_KEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
LEAST_VALUE, LEAST_ACCESS = 12, 18
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def number(text: str, digits: str) -> int:
    value = 0
    for c in text:
        value = value * len(digits) + digits.index(c)
    return value


def crc_holds(token: str) -> bool:
    """The last six of a token's characters are the CRC-32 of those after its prefix, in base 62."""
    body = token[4:]
    return number(body[-6:], BASE62) == zlib.crc32(body[:-6].encode())


def base58_holds(token: str) -> bool:
    """The last four of the decoded bytes begin the double SHA-256 of the rest."""
    try:
        raw = number(token, BASE58).to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


CHECKED = {
    "code_token": (CODE_TOKEN, crc_holds), "package_token": (PACKAGE_TOKEN, crc_holds), "extended_key": (EXTENDED_KEY, base58_holds),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed, then end."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII only, so places stay
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(low))
    out, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= LEAST_VALUE:
                    out.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    out.append((kind, at, m.end()))
        else:
            pattern, holds = CHECKED[kind]
            if (m := pattern.match(text, at)) and holds(m[0]):
                free[kind] = m.end()
                out.append((kind, at, m.end()))
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans``: all secrets of the whole text, as (kind, start, end) in code points, end exclusive.

    Base kinds, leftmost and not overlapping within a kind: ``assign`` (a key word, ``:`` or ``=``, a value of 12 characters or
    more), ``access`` (AKIA..., 18 or more), ``hex`` (16 or more). A keyword automaton over the lower-cased text says where the
    patterns are tried. Further kinds are reported only if the checksum inside the token holds. Runs of hexadecimal digits have no key
    word and are searched for by their pattern.

    Null and empty texts have no spans; rows stay as they are, in number and order; a column named like ``spans`` is replaced.
    Nothing is shuffled.
    """
    kept = [c for c in df.columns if c != spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in steps(batch, text):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, spans])

    quoted = [F.col(f"`{c}`") for c in kept]
    schema = df.select(*quoted).schema.add(spans, SPANS)
    return df.select(*quoted).mapInArrow(scan, schema)
