"""Sketches and near duplicates by them, against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
import samples
from conftest import SF
from pyspark.sql import functions as F

from gridlake.llm import components, minhash, queries, tiles


def expected(rows):
    return {(i, n, c) for i, n, c in brute.components(rows, 2, 80)}


def grouped(df, **how):
    return [tuple(r) for r in minhash.group_texts(df, **how).collect()]


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((1, 1.0), (3, 1.0), (40, 0.8), (500, 0.8), (500, 0.5), (2000, 0.0)):
        agreed = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            rest = n - len(both)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, rest, dtype=np.uint64)]) for _ in range(2))
            key, row = np.concatenate([a, b]), np.repeat([0, 2], n)
            sketch = minhash.sketches(key, row, 3)
            assert (sketch[[0, 2]] != minhash._EMPTY).all() and (sketch[1] == minhash._EMPTY).all()
            agreed.append((sketch[0] == sketch[2]).mean())
        union = 2 * n - len(both)
        assert np.mean(agreed) == pytest.approx(len(both) / union, abs=0.03)


def test_sketches_do_not_depend_on_order_or_neighbours():
    rng = np.random.default_rng(2)
    key, row = rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.sort(rng.integers(0, 9, 300))
    whole = minhash.sketches(key, row, 9)
    turn = rng.permutation(300)
    assert (minhash.sketches(key[turn], row[turn], 9) == whole).all()
    assert all((minhash.sketches(key[row == r], np.zeros((row == r).sum(), int), 1)[0] == whole[r]).all() for r in range(9))
    assert minhash.bands(whole).shape == (9, minhash.COORDINATES // minhash.BAND)


@pytest.mark.parametrize("chunk", [64, 8 << 20])
def test_groups(spark, chunk):
    rows = samples.documents()
    docs = spark.createDataFrame(rows, samples.SCHEMA).withColumn("n", F.lit(1)).withColumn("bands", F.lit("x"))
    known = [(i, t) for i, t, *_ in rows if i is not None]
    got = grouped(docs.filter("doc_id is not null"), chunk_bytes=chunk)
    assert {r[:3] for r in got} == expected(known) and len(got) == len(known)
    assert all(kept == (i == c) for i, n, c, kept in got)
    with_null = grouped(docs)
    assert len(with_null) == len(rows) and sum(i is None and c is not None for i, _, c, _ in with_null) == 1
    assert grouped(docs.limit(0)) == []


@pytest.mark.parametrize("crowded", [2, 256])
@pytest.mark.parametrize("seed", range(3))
def test_chains_hubs_and_boilerplate(spark, monkeypatch, seed, crowded):
    """Edits in chains, far copies of a hub, a passage that many otherwise different texts share; buckets crowded or not."""
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(6):
        t = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(2, 12)):
            texts.append(" ".join(t))
            for _ in range(rng.randint(1, 4)):
                t = list(t)
                t[rng.randrange(len(t))] = rng.choice(words)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [f"{passage} {' '.join(rng.choice(words) for _ in range(rng.choice([2, 8, 30, 40])))}" for _ in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r[:3] for r in got} == expected(rows)


def test_the_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_minhash(spark, SF).collect()]
    assert {r[:3] for r in got} == expected(docs) and all(r[3] == (r[0] == r[2]) for r in got)


# --- what both joins share ------------------------------------------------------------------------------------------


def brute_roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        up[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in up if top(x) != x}


@pytest.mark.parametrize(("seed", "local"), [(0, 0), (1, 0), (2, 1 << 17)])
def test_components_of_chains_stars_and_random_links(spark, monkeypatch, seed, local):
    """In rounds, and in one task."""
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    edges += [(7, 7), (2000, -5), (-5, 2000)]
    rng.shuffle(edges)
    got = components.connect(spark.createDataFrame(edges, "u long, v long").repartition(5))
    assert {tuple(r) for r in got.collect()} == brute_roots(edges)
    monkeypatch.setattr(components, "LOCAL_LINKS", 1 << 17)
    assert components.connect(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("narrow", "wide"), [(2, 4), (64, 256)])
def test_links_that_leave_the_tiles_grow_with_the_sets(spark, monkeypatch, narrow, wide):
    """Copies of one set with two own tokens each, in one cell: all pairs link, and no more links leave the tiles than a few for each set."""
    monkeypatch.setattr(tiles, "NARROW", narrow)
    monkeypatch.setattr(tiles, "WIDE", wide)
    counts = []
    for n in (20, 40):
        sets = spark.createDataFrame([(i, 42, [*range(40), 100 + 2 * i, 101 + 2 * i]) for i in range(n)] + [(n, 3, [900, 901, 902])], "uid long, n int, shared array<long>")
        held = spark.createDataFrame([(0, i, i, i > 0) for i in range(n + 1)], "cell long, uid long, root long, open boolean")
        edges = tiles.compare(held, sets, 80, spark.createDataFrame([], "u long, v long"))
        assert {tuple(r) for r in components.connect(edges).collect()} == {(i, 0) for i in range(1, n)}
        counts.append(edges.count())
    assert counts[1] <= 2.5 * counts[0] and counts[1] <= 4 * 40


def test_few_links_are_few_tasks_whatever_the_partitions(spark, monkeypatch):
    """Three rounds of tiles, each shuffled to 40 partitions that nothing coalesces: whatever reads the links has a few tasks, not those of all rounds."""
    monkeypatch.setattr(tiles, "WIDE", 8)
    rng = random.Random(8)
    sets = [(i, 30, sorted(rng.sample(range(40), 30))) for i in range(30)]
    held = spark.createDataFrame([(0, i, i, i > 0) for i in range(30)], "cell long, uid long, root long, open boolean")
    known = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(known, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        edges = tiles.compare(held, spark.createDataFrame(sets, "uid long, n int, shared array<long>"), 80, spark.createDataFrame([(0, 0)], "u long, v long").coalesce(1))
        assert edges.rdd.getNumPartitions() < 40
        got = {tuple(r) for r in components.connect(edges).collect()}
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert got == brute_roots([(a, b) for a, _, x in sets for b, _, y in sets if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})])
