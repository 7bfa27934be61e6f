"""Geometry as column expressions on rings: ARRAY<STRUCT<x DOUBLE, y DOUBLE>>, closed or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def bbox(ring: Column | str) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax expressions, for ``df.withColumns(bbox("ring"))``."""
    ring = _c(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def scale_ring(ring: Column | str, k: float) -> Column:
    """Scales about the centre of the bounding box."""
    ring = _c(ring)
    b = bbox(ring)
    centre = point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)

    def about(c: Column) -> Column:
        return F.transform(ring, lambda p: point(
            c["x"] + F.lit(k) * (p["x"] - c["x"]), c["y"] + F.lit(k) * (p["y"] - c["y"])))

    return let(centre, about)


def edges(ring: Column | str) -> Column:
    """Consecutive vertex pairs of a ring, closing it if needed: ARRAY<STRUCT<a, b>>."""
    ring = _c(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _shoelace(ring: Column) -> Column:
    """STRUCT<cross, sx, sy>: doubled signed area and the first moments, about the first vertex."""
    ox, oy = ring[0]["x"], ring[0]["y"]

    def step(acc: Column, e: Column) -> Column:
        ax, ay = e["a"]["x"] - ox, e["a"]["y"] - oy
        bx, by = e["b"]["x"] - ox, e["b"]["y"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (acc["cross"] + cross).alias("cross"),
            (acc["sx"] + (ax + bx) * cross).alias("sx"),
            (acc["sy"] + (ay + by) * cross).alias("sy"),
        )

    zero = F.struct(F.lit(0.0).alias("cross"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    return F.aggregate(edges(ring), zero, step)


def area(ring: Column | str) -> Column:
    return F.abs(_shoelace(_c(ring))["cross"]) / 2


def centroid(ring: Column | str) -> Column:
    """Area-weighted centroid; a ring without area gives the mean of its vertices."""
    ring = _c(ring)
    n = F.size(ring)

    def vertex_mean(axis: str) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / n

    def of(s: Column) -> Column:
        flat = s["cross"] == 0
        return point(
            F.when(flat, vertex_mean("x")).otherwise(ring[0]["x"] + F.try_divide(s["sx"], 3 * s["cross"])),
            F.when(flat, vertex_mean("y")).otherwise(ring[0]["y"] + F.try_divide(s["sy"], 3 * s["cross"])),
        )

    return let(_shoelace(ring), of)


def exterior(rings: Column | str) -> Column:
    """First ring of a polygon given as ARRAY<ring>; holes are ignored."""
    return F.element_at(_c(rings), 1)


def world_to_pixel(x: Column | str, y: Column | str, x0: Column, y0: Column, res: Column) -> dict[str, Column]:
    """Row and column of a coordinate by floor; (x0, y0) is the upper left corner."""
    return {
        "row": F.floor((y0 - _c(y)) / res).cast("int"),
        "col": F.floor((_c(x) - x0) / res).cast("int"),
    }


def ring_to_pixels(ring: Column | str, x0: Column, y0: Column, res: Column) -> Column:
    """Every vertex as STRUCT<row, col>."""
    return F.transform(_c(ring), lambda p: F.struct(
        F.floor((y0 - p["y"]) / res).cast("int").alias("row"),
        F.floor((p["x"] - x0) / res).cast("int").alias("col"),
    ))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes share at least a point."""
    return (
        (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
    )


def _orient(o: Column, a: Column, b: Column) -> Column:
    return F.signum((a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"]))


def _on_box(p: Column, a: Column, b: Column) -> Column:
    return (
        (p["x"] >= F.least(a["x"], b["x"])) & (p["x"] <= F.greatest(a["x"], b["x"]))
        & (p["y"] >= F.least(a["y"], b["y"])) & (p["y"] <= F.greatest(a["y"], b["y"]))
    )


def _segments_meet(e: Column, f: Column) -> Column:
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    # most pairs of edges are apart, which their boxes say for less
    near = (
        (F.least(a["x"], b["x"]) <= F.greatest(c["x"], d["x"])) & (F.least(c["x"], d["x"]) <= F.greatest(a["x"], b["x"]))
        & (F.least(a["y"], b["y"]) <= F.greatest(c["y"], d["y"])) & (F.least(c["y"], d["y"]) <= F.greatest(a["y"], b["y"])))
    return near & (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & _on_box(c, a, b)) | ((o2 == 0) & _on_box(d, a, b))
        | ((o3 == 0) & _on_box(a, c, d)) | ((o4 == 0) & _on_box(b, c, d))
    )


def _inside(sides: Column, p: Column) -> Column:
    """Crossing number of a ray to the right; points on the edge may go either way."""
    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = a["x"] + F.try_divide((p["y"] - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return straddles & (p["x"] < at)

    return F.size(F.filter(sides, crossing)) % 2 == 1


def sides_intersect(sides_a: Column | str, sides_b: Column | str) -> Column:
    """Exact polygon–polygon test on ``edges``: one holds a vertex of the other, or two edges meet."""
    sides_a, sides_b = _c(sides_a), _c(sides_b)
    crossing = F.exists(sides_a, lambda e: F.exists(sides_b, lambda f: _segments_meet(e, f)))
    return _inside(sides_b, sides_a[0]["a"]) | _inside(sides_a, sides_b[0]["a"]) | crossing


def intersects(ring_a: Column | str, ring_b: Column | str) -> Column:
    """The same test on rings."""
    sides = F.struct(edges(ring_a).alias("a"), edges(ring_b).alias("b"))
    return let(sides, lambda s: sides_intersect(s["a"], s["b"]))


# --- many rings: parts and holes ------------------------------------------------------------------------------


def rings_bbox(rings: Column | str) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax over all rings."""
    return bbox(F.flatten(_c(rings)))


def slab_index(rings: Column | str, height: float) -> Column:
    """Edges of all rings by the slabs of ``height`` that they touch: MAP<BIGINT, ARRAY<STRUCT<a, b>>>. Built once per geometry."""
    at = lambda y: F.floor(y / F.lit(float(height)))

    def of(sides: Column) -> Column:
        ys = F.transform(sides, lambda e: F.least(e["a"]["y"], e["b"]["y"]))
        tops = F.transform(sides, lambda e: F.greatest(e["a"]["y"], e["b"]["y"]))
        slabs = F.sequence(at(F.array_min(ys)), at(F.array_max(tops)))
        held = F.transform(slabs, lambda k: F.filter(sides, lambda e: (
            (at(F.least(e["a"]["y"], e["b"]["y"])) <= k) & (at(F.greatest(e["a"]["y"], e["b"]["y"])) >= k))))
        return F.map_from_arrays(slabs, held)

    every = F.flatten(F.transform(_c(rings), edges))
    return let(every, lambda sides: F.when(F.size(sides) > 0, of(sides)))


def first_points(rings: Column | str) -> Column:
    """A vertex of each ring."""
    return F.transform(F.filter(_c(rings), lambda r: F.size(r) > 0), lambda r: r[0])


def _slab(index: Column, k: Column) -> Column:
    return F.coalesce(F.try_element_at(index, k), F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def covers(index: Column, p: Column, height: float) -> Column:
    """Even-odd test of a point over all rings of a slab index: a hole takes out, a part adds. Points on an edge may go either way."""
    return _inside(_slab(index, F.floor(p["y"] / F.lit(float(height)))), p)


def indexed_intersect(index_a: Column, points_a: Column, index_b: Column, points_b: Column, height: float) -> Column:
    """Exact test on geometries with parts and holes: edges that meet, or a ring of one that begins inside the other.

    Only edges of the same slab are looked at, and for a point only those of its own.
    """
    low = F.greatest(F.array_min(F.map_keys(index_a)), F.array_min(F.map_keys(index_b)))
    high = F.least(F.array_max(F.map_keys(index_a)), F.array_max(F.map_keys(index_b)))
    common = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    crossing = F.exists(common, lambda k: F.exists(_slab(index_a, k), lambda e: F.exists(_slab(index_b, k), lambda f: _segments_meet(e, f))))
    held = F.exists(points_a, lambda p: covers(index_b, p, height)) | F.exists(points_b, lambda p: covers(index_a, p, height))
    return held | crossing  # the cheaper test first


def filter_geom_type(df: DataFrame, types: tuple[str, ...] = ("Polygon", "MultiPolygon")) -> DataFrame:
    return df.where(F.col("geom_type").isin(*types))


def explode_parts(df: DataFrame, parts: str = "parts", ring: str = "ring") -> DataFrame:
    """One row per part of a multi-part geometry, with its position as ``part``."""
    others = [c for c in df.columns if c != parts]
    return df.select(*others, F.posexplode(parts).alias("part", ring))
