"""Polygons and points to pixels, a part of a frame at a time: NumPy passes over many parts at once.

A part is a piece of a frame of ``TILE`` pixels a side or what a caller cuts; shapes travel with the bounds
``row_from``, ``row_to``, ``col_from``, ``col_to`` they are cut to (the ends are outside). Keys of a part up to ``_tc`` say where its
shapes were dealt to. What these leave is one list, made by an aggregate function, so that pixels stay where their keys
dealt the shapes and nothing is shuffled after.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import floor_div
from ..session import spread

TILE = 64  # pixels; side of the parts that frames are cut into
BOUNDS = ["row_from", "row_to", "col_from", "col_to"]
PART = ["_tr", "_tc"]
_CELLS = 1 << 21  # of the buffers that are worked on at once


def deal(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Hash-deals rows to ``parts`` tasks, or as ``spread`` does; what is dealt alike is joined and merged without a shuffle."""
    return df.repartition(parts, *columns) if parts else spread(df, *columns)


def tiles_between(low: Column, high: Column, side: int) -> Column:
    """Numbers of the tiles from one row or column to another, empty where there are none."""
    return F.when(low <= high, F.sequence(floor_div(low, side), floor_div(high, side))).otherwise(F.array().cast("array<int>"))


def cut_to_parts(shapes: DataFrame, keys: list[str], box: dict[str, Column], shape: bool) -> tuple[DataFrame, list[str]]:
    """``shapes`` once for each part of their frame that ``box`` (first and last row and column) meets, parts dealt to tasks; and the keys of a part.

    Shapes that come with bounds are parts already and stay where they are.
    """
    if set(BOUNDS) <= set(shapes.columns):
        return shapes, keys
    if shape:
        shapes = shapes.where(F.col("rows").isNotNull() & F.col("cols").isNotNull())
    ends = {c: (F.greatest(box[c + "_low"], F.lit(0)), F.least(box[c + "_high"], F.col(c + "s") - 1)) if shape else (box[c + "_low"], box[c + "_high"]) for c in ("row", "col")}
    cut = shapes.withColumn("_tr", F.explode(tiles_between(*ends["row"], TILE))).withColumn("_tc", F.explode(tiles_between(*ends["col"], TILE)))
    for c, t in (("row", "_tr"), ("col", "_tc")):
        first, last = F.col(t) * TILE, (F.col(t) + 1) * TILE
        cut = cut.withColumns({
            c + "_from": F.greatest(first, F.lit(0)) if shape else first,
            c + "_to": F.least(last, F.col(c + "s")) if shape else last})
    return spread(cut, *keys, *PART), [*keys, *PART]


Fill = Callable[[dict[str, pa.Array], list[np.ndarray], np.ndarray, "_Parts"], dict[str, np.ndarray]]


def paint(shapes: DataFrame, keys: list[str], fields: dict[str, Column], fill: Fill, kind: str, grid: int = 1, pad: int = 0) -> DataFrame:
    """One row per pixel that ``fill`` leaves of the ``fields`` of a part's shapes: keys, row, col and, of type ``kind``, value.

    Keys after ``_tc`` are whole numbers below 2**53: all that Python hands back is one list of doubles, as anything else that an
    aggregate returns is taken apart value by value.
    """
    dealt, inner = keys[:keys.index("_tc") + 1], keys[keys.index("_tc") + 1:]
    names, whole = [*inner, *BOUNDS, *fields], [*inner, "row", "col"]

    def run(*columns: pa.Array) -> pa.Scalar:
        return _by_parts(dict(zip(names, columns)), inner, grid, pad, fill)

    cut = shapes.select(*keys, *BOUNDS, *[c.alias(n) for n, c in fields.items()])
    filled = cut.groupBy(*dealt).agg(F.arrow_udf(run, T.ArrayType(T.DoubleType()))(*names).alias("_p"))
    n = (F.size("_p") / F.lit(len(whole) + 1)).cast("int")
    lists = filled.select(*dealt, *[F.slice("_p", n * i + 1, n).alias(c) for i, c in enumerate([*whole, "value"])])
    # outer: for other generators Spark adds a filter and fills a second time
    pixels = lists.select(*dealt, F.inline_outer(F.arrays_zip(*whole, "value"))).where(F.col("row").isNotNull())
    types = {k: shapes.schema[k].dataType for k in inner} | {"row": "int", "col": "int"}
    return pixels.select(*dealt, *[F.col(k).cast(t).alias(k) for k, t in types.items()], F.when(~F.isnan("value"), F.col("value")).cast(kind).alias("value"))


class _Parts:
    """Buffers of consecutive parts in one flat array; each part has ``height`` lines of ``stride`` cells."""

    def __init__(self, bounds: list[np.ndarray], counts: np.ndarray, grid: int, pad: int):
        starts = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        r0, r1, c0, c1 = (np.zeros(len(counts), np.int64) for _ in range(4))
        for out, of, fold in ((r0, 0, np.minimum), (r1, 1, np.maximum), (c0, 2, np.minimum), (c1, 3, np.maximum)):
            if len(some):
                out[some] = fold.reduceat(bounds[of], starts[some])
        self.row0, self.col0 = r0 * grid, c0 * grid
        self.height, self.width = np.maximum(r1 - r0, 0) * grid, np.maximum(c1 - c0, 0) * grid
        self.stride = self.width + pad
        self.cells = self.height * self.stride
        self.base = np.cumsum(self.cells) - self.cells
        self.size = int(self.cells.sum())

    def at(self, part: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return self.base[part] + (row - self.row0[part]) * self.stride[part] + (col - self.col0[part])

    def back(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, row and column of cells in ascending order."""
        part = np.repeat(np.arange(len(self.base)), np.diff(np.append(np.searchsorted(cells, self.base), len(cells))))
        inside = cells - self.base[part]
        line = inside // self.stride[part]
        return part, line + self.row0[part], inside - line * self.stride[part] + self.col0[part]


def _counted(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _number(values: pa.Array, kind: type) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _by_parts(columns: dict[str, pa.Array], inner: list[str], grid: int, pad: int, fill: Fill) -> np.ndarray:
    """Inner keys, rows, columns and values of the pixels of all shapes, one after the other, ``fill`` called on as many parts as ``_CELLS`` hold."""
    part = np.zeros(len(columns[BOUNDS[0]]), np.int64)
    for k in inner:
        key = _number(columns[k], np.int64)
        if len(key) and max(-key.min(), key.max()) >= 1 << 53:
            raise ValueError(f"{k} holds numbers of 2**53 or more")
        part = np.unique(np.stack([part, key]), axis=1, return_inverse=True)[1] if k != inner[0] else np.unique(key, return_inverse=True)[1]
    if inner:
        order = np.argsort(part, kind="stable")
        columns, part = {n: c.take(pa.array(order)) for n, c in columns.items()}, part[order]
    bounds = [_number(columns[b], np.int64) for b in BOUNDS]
    counts = np.bincount(part)
    ends = np.cumsum(counts)
    group = np.cumsum(_Parts(bounds, counts, grid, pad).cells) // _CELLS
    out = []
    for g in np.unique(group):
        first, last = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
        a, z = ends[first] - counts[first], ends[last - 1]
        mine = [b[a:z] for b in bounds]
        filled = fill({n: c.slice(a, z - a) for n, c in columns.items()}, mine, part[a:z] - first, _Parts(mine, counts[first:last], grid, pad))
        shape = (ends - counts)[first:last][filled["part"]]
        out.append([*[_number(columns[k], np.float64)[shape] for k in inner], filled["row"], filled["col"], filled.get("value", np.zeros(len(shape)))])
    return np.concatenate([np.concatenate(c) for c in zip(*out)]).astype(np.float64)


def _edges(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ring number and ends of the consecutive vertex pairs of rings, closed; pairs that lack a coordinate are left out."""
    counts = _counted(rings)
    points = rings.flatten()
    x, y = (_number(points.field(c), np.float64) for c in ("x", "y"))
    of = np.repeat(np.arange(len(counts)), counts)
    after = np.arange(1, len(x) + 1)
    ends = np.cumsum(counts)[counts > 0]
    after[ends - 1] = ends - counts[counts > 0]
    whole = np.isfinite(x) & np.isfinite(y) & np.isfinite(x[after]) & np.isfinite(y[after])
    after = after[whole]
    return of[whole], x[whole], y[whole], x[after], y[after]


def _many(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and number, for ranges of ``n`` numbers from ``first`` on."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _runs(edges: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray, centre: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ring, row and the two crossings of the stretches of a row that lie inside, rows ``low`` to ``high`` of each ring."""
    of, ax, ay, bx, by = edges
    down, up = np.minimum(ay, by), np.maximum(ay, by)
    first = np.maximum(np.ceil(down - centre), low[of]).astype(np.int64)
    last = np.minimum(np.floor(up - centre), high[of]).astype(np.int64)
    e, row = _many(first, np.maximum(last - first + 1, 0))
    y = row + centre
    crossed = (down[e] <= y) & (y < up[e])
    e, row, y = e[crossed], row[crossed], y[crossed]
    x = ax[e] + (y - ay[e]) * (bx[e] - ax[e]) / (by[e] - ay[e])
    lines = np.maximum(high - low + 1, 0)
    line = (np.cumsum(lines) - lines)[of[e]] + row - low[of[e]]
    met = np.bincount(line) if len(line) else np.zeros(0, np.int64)
    if (met[met > 0] == 2).all():
        order = np.argsort(line, kind="stable").reshape(-1, 2)
        left, right = x[order[:, 0]], x[order[:, 1]]
        return of[e[order[:, 0]]], row[order[:, 0]], np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((x, line))
    sorted_line = line[order]
    rank = np.arange(len(order)) - (np.cumsum(met) - met)[sorted_line]
    opens = np.flatnonzero((rank % 2 == 0) & (rank + 1 < met[sorted_line]))
    return of[e[order[opens]]], row[order[opens]], x[order[opens]], x[order[opens + 1]]


def filled_rings(fill: int, outline: int) -> Fill:
    """Pixels of the rings of a part: inside ``fill``, on the outline ``outline``; of several the last in the order of ``seq``, outlines after insides."""
    nothing, unordered = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1

    def one(shapes: dict[str, pa.Array], bounds: list[np.ndarray], of: np.ndarray, parts: _Parts) -> dict[str, np.ndarray]:
        r0, r1, c0, c1 = bounds
        edges = _edges(shapes["ring"])
        seq = shapes["seq"]
        lacks = seq.is_null().to_numpy(zero_copy_only=False)
        turn = np.where(lacks, unordered, _number(seq.fill_null(0), np.int64) * 2)
        best = np.full(parts.size, nothing, np.int64)

        ring, row, left, right = _runs(edges, r0, r1 - 1, 0.0)
        a = np.maximum(np.ceil(left), c0[ring]).astype(np.int64)
        z = np.minimum(np.floor(right), c1[ring] - 1).astype(np.int64)
        run, col = _many(a, np.maximum(z - a + 1, 0))
        ring, row = ring[run], row[run]
        np.maximum.at(best, parts.at(of[ring], row, col), turn[ring])

        ring, ax, ay, bx, by = edges
        dr, dc = by - ay, bx - ax
        n = np.maximum(np.maximum(np.abs(dr), np.abs(dc)), 1.0)
        # steps of an edge that come near the part
        first, last = np.zeros(len(n)), np.ceil(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for begin, d, low, high in ((ay, dr, r0[ring] - 2, r1[ring] + 2), (ax, dc, c0[ring] - 2, c1[ring] + 2)):
                to_low, to_high = (low - begin) / d * n, (high - begin) / d * n
                near = (low <= begin) & (begin <= high)
                first = np.maximum(first, np.where(d == 0, np.where(near, 0, np.inf), np.floor(np.minimum(to_low, to_high))))
                last = np.minimum(last, np.where(d == 0, np.where(near, last, -1), np.ceil(np.maximum(to_low, to_high))))
        some = np.flatnonzero(first <= last)
        step, t = _many(first[some].astype(np.int64), (last[some] - first[some]).astype(np.int64) + 1)
        e = some[step]
        at = np.minimum(t / n[e], 1.0)
        row = np.floor(ay[e] + dr[e] * at + 0.5).astype(np.int64)
        col = np.floor(ax[e] + dc[e] * at + 0.5).astype(np.int64)
        ring = ring[e]
        inside = (r0[ring] <= row) & (row < r1[ring]) & (c0[ring] <= col) & (col < c1[ring])
        ring, row, col = ring[inside], row[inside], col[inside]
        np.maximum.at(best, parts.at(of[ring], row, col), np.where(lacks[ring], unordered, turn[ring] + 1))

        cells = np.flatnonzero(best != nothing)
        won = best[cells]
        part, row, col = parts.back(cells)
        return {"part": part, "row": row, "col": col, "value": np.where(won == unordered, np.nan, np.where(won % 2 == 1, outline, fill))}

    return one


def gap_spots(grid: int) -> Fill:
    """Pixels of a part with a spot that lies in two rings or more with ``own`` 0 and in none with ``own`` 1; rings are ``grid`` times as large as pixels."""

    def one(shapes: dict[str, pa.Array], bounds: list[np.ndarray], of: np.ndarray, parts: _Parts) -> dict[str, np.ndarray]:
        r0, r1, c0, c1 = (b * grid for b in bounds)

        def covered(name: str) -> np.ndarray:
            ring, row, left, right = _runs(_edges(shapes[name]), r0, r1 - 1, 0.5)
            a = np.maximum(np.ceil(left - 0.5), c0[ring]).astype(np.int64)
            z = np.minimum(np.ceil(right - 0.5), c1[ring]).astype(np.int64)
            some = a < z
            part, row, a, z = of[ring[some]], row[some], a[some], z[some]
            line = parts.at(part, row, parts.col0[part])
            opened = np.bincount(line + a - parts.col0[part], minlength=parts.size)
            return np.cumsum(opened - np.bincount(line + z - parts.col0[part], minlength=parts.size))

        spots = np.flatnonzero((covered("scaled") >= 2) & (covered("own") == 0))
        part, row, col = parts.back(spots)
        pixels = _Parts(bounds, np.bincount(of, minlength=len(parts.base)), 1, 0)
        touched = np.zeros(pixels.size, bool)
        touched[pixels.at(part, row // grid, col // grid)] = True
        part, row, col = pixels.back(np.flatnonzero(touched))
        return {"part": part, "row": row, "col": col}

    return one


def stamped_points(line: list[float]) -> Fill:
    """Sum over the points of a part of ``n`` times the kernel ``line`` x ``line``, which sits one pixel below and right of a point."""
    size, weights = len(line), np.array(line)
    half = (size - 1) // 2
    reach = size - half

    def one(shapes: dict[str, pa.Array], bounds: list[np.ndarray], of: np.ndarray, parts: _Parts) -> dict[str, np.ndarray]:
        row, col, n = (_number(shapes[c], k) for c, k in (("row", np.int64), ("col", np.int64), ("n", np.float64)))
        point = np.repeat(np.arange(len(row)), size)
        k = np.tile(np.arange(size), len(row))
        down = row[point] + k + 1 - half
        lands = (bounds[0][point] <= down) & (down < bounds[1][point]) & (bounds[2][point] <= col[point] + reach) & (col[point] + 1 - half < bounds[3][point])
        point, k, down = point[lands], k[lands], down[lands]
        # a line begins ``reach`` columns before the part and ends where the last point that reaches it may lie
        cells = parts.at(of[point], down, col[point] + reach)

        def across(down: np.ndarray, right: np.ndarray) -> np.ndarray:
            tall = np.bincount(cells, weights=n[point] * down[k], minlength=parts.size)
            padded, out = np.concatenate([tall, np.zeros(size)]), np.zeros(parts.size)
            for j in range(size):
                out += right[j] * padded[size - 1 - j:size - 1 - j + parts.size]
            return out

        density = across(weights, weights)
        reached = density if weights.min() > 1e-150 else across(np.ones(size), np.ones(size))
        part, row, col = parts.back(np.flatnonzero(reached > 0))
        inside = col < parts.col0[part] + parts.width[part]
        part, row, col = part[inside], row[inside], col[inside]
        return {"part": part, "row": row, "col": col, "value": density[parts.at(part, row, col)]}

    return one
