"""Plain restatements of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    t = (text or "").translate(LOW) if lower else text or ""
    return [w for w in BLANKS.split(t) if w]


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dups = set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def quality_scores(texts, trusted, buckets, scale):
    """Mean weights in millionths; ``trusted`` flags the texts of the target."""
    bucket = lambda data, seed=42: xxhash.xxh64(data, seed=seed).intdigest()
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def grams(t):
        w = [x.encode() for x in words(t)]
        one = [signed(bucket(x)) % buckets for x in w]
        # a hash of two columns takes the first one's as its seed
        two = [signed(bucket(b, bucket(a))) % buckets for a, b in zip(w, w[1:])]
        return one + two

    every = [grams(t) for t in texts]
    raw, good = Counter(), Counter()
    for g, t in zip(every, trusted):
        raw.update(g)
        if t:
            good.update(g)
    r, n = sum(raw.values()), sum(good.values())
    weight = {b: round(scale * (math.log((good[b] + 1) / (n + buckets)) - math.log((raw[b] + 1) / (r + buckets)))) for b in raw}
    half_up = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    return [half_up(sum(weight[b] for b in g) / len(g)) if g else 0 for g in every]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def decontaminated(docs, items, size=10):
    """(n_words, n_hit, sorted ids) of each text."""
    wins = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def base_spans(text):
    t = text or ""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def dedup_lines(texts, least=50):
    """Texts in order, each run of lines with ``least`` words that occurs earlier deleted."""
    rows = [[] if t is None else t.split("\n") for t in texts]
    size = [[len(words(x)) for x in r] for r in rows]
    first, gone = {}, [set() for _ in rows]
    # every window of lines with enough words that is as short as can be, from its first or its last line on
    for forward in (True, False):
        first.clear()
        for d, r in enumerate(rows):
            spans = []
            for i in range(len(r)):
                total, j = 0, i
                while 0 <= j < len(r):
                    total += size[d][j]
                    if total >= least:
                        spans.append((min(i, j), max(i, j)))
                        break
                    j += 1 if forward else -1
            for a, b in sorted(spans):
                key = tuple(r[a : b + 1])
                if key in first:
                    gone[d] |= set(range(a, b + 1))
                else:
                    first[key] = (d, a)
    return [None if t is None else "\n".join(x for i, x in enumerate(r) if i not in g) for t, r, g in zip(texts, rows, gone)]


def lm_scores(docs, mass, folds=7, held=2):
    """(held_out, n_tokens, n_known, train_tokens, base, score) of each (id, text)."""
    toks = [[*words(t, True), None] for _, t in docs]
    out_of = [i is not None and zlib.crc32(str(i).encode()) % folds == held for i, _ in docs]
    uni, bi = Counter(), Counter()
    for t, h in zip(toks, out_of):
        if not h:
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    rows = []
    for t, h in zip(toks, out_of):
        base = score = 0.0
        state = None
        for w in t:
            p = (uni[w] + 1) / (n + v + 1)
            base += math.log10(p)
            c, s = bi[state, w], uni[state]
            score += math.log10((c + mass * p) / (s + mass)) if c else math.log10(mass / (s + mass)) + math.log10(p)
            state = w
        rows.append((h, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return rows


def shingle_set(text, n=5):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, size=5, percent=75):
    """(id, size of the set, smallest id of its component) by comparing all pairs that share a shingle."""
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    met = {(a, b) for rows in where.values() for a in rows for b in rows if a < b}
    for a, b in met:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    low = {}
    for i, (id, _) in enumerate(docs):
        r = find(i)
        low[r] = min(low.get(r, id), id)
    return [(id, len(s), low[find(i)]) for i, ((id, _), s) in enumerate(zip(docs, sets))]
