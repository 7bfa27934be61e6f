"""Product codes and centroid clustering against brute force in Python integers, and the queries against DuckDB."""

from __future__ import annotations

import hashlib
import inspect
import math
import random
from itertools import product

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridlake.llm import centroids, oracles, queries, vector_codes
from gridlake.llm.vectors import kept as kept_rows

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v long, c0 string, row string"


def vectors(size, seed=1, n=60, groups=0):
    """Rows with nulls, non-finite components, other lengths, repeated rows and ids, ties and clashing column names."""
    rng = random.Random(seed)
    spots = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(groups)]

    def one():
        if spots:
            return [x + rng.uniform(-0.01, 0.01) for x in rng.choice(spots)]
        return [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-2, 2)]) for _ in range(size)]

    rows = [(i, one(), rng.choice([0, 1, None]), "x", 1, "y", "z") for i in range(n)]
    rows += [rows[3], rows[3], (5, one(), 2, None, None, None, None), (None, one(), 1, None, None, None, None), (-7, rows[9][1], 0, None, None, None, None)]
    odd = [None, [], [0.5] * (size - 1), [0.5] * (size + 4), [None] + [0.5] * (size - 1), [math.nan] + [0.5] * (size - 1), [0.5] * (size - 1) + [math.inf]]
    rows += [(1000 + i, v, 0, None, None, None, None) for i, v in enumerate(odd)]
    rng.shuffle(rows)
    return rows


def floors(row):
    return tuple(math.floor(1024 * float(np.float32(x))) for x in row)


def whole(row, size):
    return row is not None and len(row) == size and all(x is not None and math.isfinite(x) for x in row)


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def mean(rows):
    return tuple(sum(c) // len(rows) for c in zip(*rows, strict=True))


def brute_clusters(rows, clusters, size, rounds, seed):
    kept = [(i, floors(v)) for i, v, *_ in rows if whole(v, size)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cs = [v for _, v in first[:clusters]]
    place = lambda v: min((away(v, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        cs = [mean([v for (_, v), a in zip(kept, at, strict=True) if a == k]) if k in at else c for k, c in enumerate(cs)]
    found = [(i, *place(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, k, d, sum(e for _, e, q in found if q == k), total, list(cs[k])) for i, d, k in found), key=str)


def brute_codes(rows, size, parts, entries, rounds):
    last = lambda i: (i is None, i or 0)
    kept = sorted(((i, floors(v), label) for i, v, label, *_ in rows if whole(v, size)), key=lambda r: (last(r[0]), r[1]))
    w = size // parts
    cut = [[v[p * w:p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    place = lambda x, book: min((away(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [place(c[p], books[p])[1] for c in cut]
            books[p] = [mean([c[p] for c, a in zip(cut, at, strict=True) if a == k]) if k in at else e for k, e in enumerate(books[p])]
    found = [[place(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {label: sum(e for e, r in zip(error, kept, strict=True) if r[2] == label) for _, _, label in kept}
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, label, by[label]) for (i, _, label), f, e in zip(kept, found, error, strict=True)]
    return sorted(out, key=str), [[list(e) for e in book] for book in books]


@pytest.mark.parametrize(("seed", "clusters", "groups"), [(1, 4, 0), (2, 100, 0), (3, 5, 5)])
def test_clusters_are_those_of_brute_force(spark, seed, clusters, groups):
    rows = vectors(6, seed, groups=groups)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, clusters=clusters, dimensions=6, rounds=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, clusters, 6, 4, centroids.SEED)
    assert centroids.cluster_vectors(df.limit(0), dimensions=6).count() == 0


def test_clustering_runs_on_the_jvm_alone():
    source = inspect.getsource(centroids)
    assert not any(word in source for word in ("InArrow", "InPandas", "udf", "rdd", "numpy"))


@pytest.mark.parametrize(("seed", "entries", "groups", "block"), [(1, 8, 0, 16), (2, 256, 0, 256), (3, 6, 4, 4), (4, 3, 2, 1)])
def test_codes_are_those_of_brute_force(spark, monkeypatch, seed, entries, groups, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rows = vectors(8, seed, groups=groups)
    got, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries, rounds=3)
    expected, expected_books = brute_codes(rows, 8, 4, entries, 3)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert books == expected_books


def test_codes_of_no_and_of_odd_vectors(spark):
    df = spark.createDataFrame(vectors(8), SCHEMA)
    got, books = vector_codes.compress(df.limit(0))
    assert got.count() == 0 and books == [[[0]]] * 4
    assert vector_codes.compress(df.filter("size(embedding) = 7"))[0].count() == 0
    large = spark.createDataFrame([(0, [1e9, 0.0, 0.0, 0.0], 0, None, None, None, None)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(large)[0].collect()


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_every_cell_and_steps_to_neighbours(dimensions, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dimensions)))
    place = vector_codes.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walked = cells[np.argsort(place)]
    assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("spread", [3, 300, 1 << 20])
def test_shortlists_hold_every_nearest_entry(spread):
    rng = np.random.default_rng(4)
    for _ in range(50):
        book = rng.integers(-1000, 1000, (40, 5))
        rows = rng.integers(-1000, 1000, 5) + rng.integers(-spread, spread + 1, (30, 5))
        listed = vector_codes.shortlist(rows.min(0), rows.max(0), book)
        all_of = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        entry, distance = vector_codes.nearest(rows, book, listed)
        assert (entry == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()
        if spread == 3:
            assert len(listed) < 10  # a narrow box leaves few entries


def test_blocks_of_clustered_vectors_list_few_entries(spark):
    rng = np.random.default_rng(5)
    spots = rng.uniform(-1, 1, (32, 16))
    rows = [(i, (spots[i % 32] + rng.normal(0, 0.002, 16)).tolist(), 0) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blocks = vector_codes._blocks(kept_rows(df, "vec_id", "embedding", F.lit(True), "label"), 16).collect()
    book = np.floor(1024 * spots).astype(np.int64)
    listed = [len(vector_codes.shortlist(np.array(b["lo"][:4]), np.array(b["hi"][:4]), book[:, :4])) for b in blocks for _ in range(b["n"])]
    assert np.median(listed) < 16


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroids"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = con.execute(queries.ORACLE[name])
    names = [c[0] for c in expected.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_the_sql_is_that_of_brute_force():
    rows = vectors(64, n=40)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows])
    got = con.execute(oracles.centroids_sql(rounds=3)).fetchall()
    expected = brute_clusters(rows, 8, 64, 3, centroids.SEED)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert sorted(got, key=str) == sorted(((*r[:5], sha(r[5])) for r in expected), key=str)
