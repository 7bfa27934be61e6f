"""Exact gaps between crowns against closed forms and sampling; geometries of several rings against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry as g
from gridlake.operators import gaps as gp, spatial_join as sj

RINGS = "frame_id long, ring array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def turned(cx, cy, r, angle=0.0, n=4):
    return [(cx + r * math.cos(angle + 2 * math.pi * i / n), cy + r * math.sin(angle + 2 * math.pi * i / n)) for i in range(n)]


def areas_of(spark, rings, k=1.5, cell=16.0):
    df = spark.createDataFrame([(0, [tuple(map(float, p)) for p in r]) for r in rings], RINGS)
    parts = gp.gap_parts(gp.gap_polygons(df, ["frame_id"], k, cell), ["frame_id"]).collect()
    return sorted(r["area"] for r in parts)


@pytest.mark.parametrize("cell", [3.0, 16.0, 100.0])
@pytest.mark.parametrize("shift", [0.0, -7.3])
def test_the_gap_between_two_squares(spark, cell, shift):
    """Squares of side 4 one unit apart, scaled to 6: they share a strip of 1 x 6 between them, and two units of each other's inside."""
    rings = [box(shift, shift, 4 + shift, 4 + shift), box(5 + shift, shift, 9 + shift, 4 + shift)]
    # the scaled ones reach from -1 to 5 and from 4 to 10: both cover 4 to 5, over heights -1 to 5
    assert areas_of(spark, rings, cell=cell) == [pytest.approx(6.0)]


def test_gaps_of_several_parts_and_thin_strips(spark):
    """Three squares in a row that nearly touch: strips a thousandth of a unit wide stay, each its own part."""
    rings = [box(0, 0, 4, 4), box(4.001, 0, 8.001, 4), box(8.002, 0, 12.002, 4)]
    # above and below the row the scaled squares overlap as well: from 3.001 to 5 and 7.002 to 9.001, one unit high on either side, joined by the strip
    one = 0.001 * 4 + 2 * (5 - 3.001) * 1
    assert areas_of(spark, rings) == [pytest.approx(one), pytest.approx(one)]
    assert areas_of(spark, rings, cell=2.0) == [pytest.approx(one), pytest.approx(one)]


def test_touching_crowns_and_single_ones(spark):
    assert areas_of(spark, [box(0, 0, 4, 4)]) == []
    assert areas_of(spark, [box(0, 0, 4, 4), box(40, 0, 44, 4)]) == []
    # edges that lie on one another: no gap between, two rectangles above and below
    assert areas_of(spark, [box(0, 0, 4, 4), box(4, 0, 8, 4)]) == [pytest.approx(2.0), pytest.approx(2.0)]
    assert areas_of(spark, [box(0, 0, 4, 4), box(0, 0, 4, 4)]) == [pytest.approx(36.0 - 16.0)]  # a ring around both


@pytest.mark.parametrize("cell", [2.5, 50.0])
def test_the_gap_between_two_turned_squares(spark, cell):
    """Squares on their corners with half diagonal 2, centres 5 apart: scaled to 3, they share a square of half diagonal 1/2 in the middle, outside of both."""
    rings = [turned(0, 0, 2), turned(5, 0, 2)]
    assert areas_of(spark, rings, cell=cell) == [pytest.approx(2 * 0.5 ** 2)]


def sampled(rings, k, n=400):
    """Share of gap points on a fine grid, and the number of 4-connected groups of them."""
    def inside(ring, x, y):
        hit = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if (ya > y) != (yb > y) and x < xa + (y - ya) * (xb - xa) / (yb - ya):
                hit = not hit
        return hit

    def grown(ring):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        cx, cy = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
        return [(cx + k * (x - cx), cy + k * (y - cy)) for x, y in ring]

    larger = [grown(r) for r in rings]
    xs, ys = [p[0] for r in larger for p in r], [p[1] for r in larger for p in r]
    x0, y0, w, h = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
    hits = 0
    for i in range(n):
        for j in range(n):
            x, y = x0 + (i + 0.5) * w / n, y0 + (j + 0.5) * h / n
            if sum(inside(r, x, y) for r in larger) >= 2 and not any(inside(r, x, y) for r in rings):
                hits += 1
    return hits * w * h / n / n


@pytest.mark.parametrize("seed", range(3))
def test_random_crowns_by_sampling(spark, seed):
    rng = random.Random(seed)
    rings = [turned(rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(1, 4), rng.uniform(0, 3), rng.randint(3, 7)) for _ in range(8)]
    expected = sampled(rings, 1.5, 250)
    for cell in (4.0, 64.0):
        assert sum(areas_of(spark, rings, cell=cell)) == pytest.approx(expected, rel=0.02, abs=0.3)
    a, b = areas_of(spark, rings, cell=4.0), areas_of(spark, rings, cell=64.0)
    assert a == pytest.approx(b, rel=1e-6, abs=1e-6), "parts do not depend on the cells"


def test_burnt_gaps_are_the_pixels_of_the_strip(spark):
    rings = [box(2, 2, 6, 6), box(7, 2, 11, 6)]
    df = spark.createDataFrame([(3, [tuple(map(float, p)) for p in r]) for r in rings], RINGS)
    sizes = spark.createDataFrame([(3, 5, 20)], "frame_id long, rows int, cols int")
    burnt = gp.burn_gaps(gp.gap_polygons(df, ["frame_id"]), ["frame_id"], sizes)
    assert {(r["row"], r["col"]) for r in burnt.collect()} == {(r, c) for r in range(1, 5) for c in (6, 7)}  # gap: rows 1 to 7, columns 6 to 7; the frame ends at 5
    assert gp.gap_polygons(df.limit(0), ["frame_id"]).count() == 0


# --- several rings -------------------------------------------------------------------------------------------------

PARTS = "id long, rings array<array<struct<x:double,y:double>>>"


def many(spark, rows):
    return spark.createDataFrame([(i, None if rings is None else [[tuple(map(float, p)) for p in r] for r in rings]) for i, rings in rows], PARTS)


def pairs(spark, left, right, cell=8.0):
    got = sj.intersecting_pairs(many(spark, left), many(spark, right), cell)
    return {(r["l_id"], r["r_id"]) for r in got.collect()}


def test_holes_and_parts(spark):
    donut = [box(0, 0, 20, 20), box(4, 4, 16, 16)]
    island = [*donut, box(8, 8, 12, 12)]
    left = [(1, [box(9, 9, 11, 11)]), (2, [box(1, 1, 2, 2)]), (3, [box(15, 15, 17, 17)]), (4, [box(30, 30, 31, 31), box(5, 5, 6, 6)]), (5, [box(-9, -9, 40, 40)]),
            (6, [box(30, 0, 31, 1), box(19, 19, 22, 22)]), (7, None), (8, []), (9, [box(4, 4, 16, 16)]), (10, [[(-5, 10), (25, 10.5), (25, 10)]])]
    assert pairs(spark, left, [(0, donut)]) == {(2, 0), (3, 0), (5, 0), (6, 0), (9, 0), (10, 0)}
    assert pairs(spark, left, [(0, island)]) == {(1, 0), (2, 0), (3, 0), (5, 0), (6, 0), (9, 0), (10, 0)}
    assert pairs(spark, [(0, donut)], left) == {(0, i) for i in (2, 3, 5, 6, 9, 10)}
    first = sj.assign_first_area_of_parts(many(spark, left), many(spark, [(5, island), (3, donut)]), 8.0).collect()
    assert {tuple(r) for r in first} == {(1, 5), (2, 3), (3, 3), (5, 3), (6, 3), (9, 3), (10, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_random_polygons_of_one_ring_agree_with_the_plain_test(spark, seed):
    rng = random.Random(seed)
    shape = lambda: turned(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(1, 12), rng.uniform(0, 3), rng.randint(3, 9))
    left, right = [(i, [shape()]) for i in range(40)], [(i, [shape()]) for i in range(40)]
    plain = sj.join_boxes(
        *[sj.with_bbox(many(spark, rows).select("id", F.col("rings")[0].alias("ring"))) for rows in (left, right)], 8.0).where(g.intersects("l_ring", "r_ring"))
    assert pairs(spark, left, right) == {(r["l_id"], r["r_id"]) for r in plain.collect()}


def test_slabs_hold_the_edges_they_touch(spark):
    df = many(spark, [(0, [box(0, 0, 2, 9), box(0.5, 1, 1, 2)])]).select(g.slab_index("rings", 4.0).alias("m"), g.first_points("rings").alias("p"))
    row = df.select("*", g.covers(F.col("m"), g.point(F.lit(0.7), F.lit(1.5)), 4.0).alias("hole"), g.covers(F.col("m"), g.point(F.lit(0.2), F.lit(8.5)), 4.0).alias("body"),
                    g.covers(F.col("m"), g.point(F.lit(0.2), F.lit(80.0)), 4.0).alias("far")).first()
    assert sorted(row["m"]) == [0, 1, 2] and len(row["m"][0]) > len(row["m"][1])
    assert (row["hole"], row["body"], row["far"]) == (False, True, False) and len(row["p"]) == 2


def test_heights_are_swept_together_in_any_number(monkeypatch):
    rng = random.Random(3)
    rings = [np.array(turned(rng.uniform(2, 14), rng.uniform(2, 14), rng.uniform(1, 5), rng.uniform(0, 3), rng.randint(3, 7))) for _ in range(24)]
    scaled, cell = np.array([i % 3 > 0 for i in range(24)]), (0.0, 0.0, 16.0, 16.0)
    calls = []
    at = gp._gaps_at
    monkeypatch.setattr(gp, "_gaps_at", lambda *a: calls.append(len(a[3])) or at(*a))
    whole = gp.trapezoids(rings, scaled, cell)
    assert len(whole) > 10 and len(calls) == 1 and calls[0] > 50
    monkeypatch.setattr(gp, "_AT_ONCE", 1)
    assert gp.trapezoids(rings, scaled, cell) == whole
    assert max(calls[1:]) == 1
