"""Gaps between crowns as polygons: the exact overlay, cell by cell, as trapezoids between edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import bbox, point, scale_ring
from ..session import cut_lineage, spread
from .labels import rasterize
from .objects import connect

#: Side of a cell in units of the rings, and the share of it below which two heights or widths are one.
CELL, TINY = 16.0, 1e-12
#: Cells along a side of the block that a task takes at a time, and pairs of an edge and a height that it holds at once.
BLOCK, _AT_ONCE = 4, 1 << 18

_PIECE = "cx long, cy long, local int, y0 double, y1 double, l0 double, r0 double, l1 double, r1 double"


def _sides(rings: list[np.ndarray], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """((xa, ya, xb, yb) of the edges that go up through the stretch of heights, the ring of each)."""
    sizes = np.array([len(ring) for ring in rings])
    ends = np.cumsum(sizes)
    a = np.concatenate(rings)
    after = np.arange(1, len(a) + 1)
    after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    b = a[after]
    side = np.where((a[:, 1] < b[:, 1])[:, None], np.hstack([a, b]), np.hstack([b, a]))
    kept = (side[:, 1] < side[:, 3]) & (side[:, 1] < high) & (side[:, 3] > low)
    return side[kept], np.repeat(np.arange(len(rings)), sizes)[kept]


def _x_at(sides: np.ndarray, y: float | np.ndarray) -> np.ndarray:
    xa, ya, xb, yb = sides.T
    return xa + (xb - xa) * ((y - ya) / (yb - ya))


def _crossings(sides: np.ndarray, low: float, high: float) -> np.ndarray:
    """Heights at which two sides cross."""
    xa, ya, xb, yb = sides.T
    slope = (xb - xa) / (yb - ya)
    start = xa - slope * ya  # x at height 0
    turn = slope[:, None] - slope[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (start[None, :] - start[:, None]) / turn
    y0, y1 = np.maximum(np.maximum(ya[:, None], ya[None, :]), low), np.minimum(np.minimum(yb[:, None], yb[None, :]), high)
    i, j = np.nonzero(np.triu((turn != 0) & (y > y0) & (y < y1), 1))
    return y[i, j]


def _gaps_at(sides: np.ndarray, owner: np.ndarray, scaled: np.ndarray, mids: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the height, edge on the left, edge on the right) of the gaps at each of the heights, from left to right; owners -1 and -2 are the sides of the box."""
    xa, ya, xb, yb = sides.T
    y = mids[:, None]
    here = (ya <= y) & (yb >= y)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(here, xa + (xb - xa) * ((y - ya) / (yb - ya)), np.inf)
    order = np.argsort(x, axis=1, kind="stable")[:, :here.sum(axis=1).max()]
    x, here = np.take_along_axis(x, order, 1), np.take_along_axis(here, order, 1)
    ring = owner[order]
    # a ring is entered at its odd edges and left at its even ones
    by_ring = np.argsort(np.where(here, ring, len(scaled)), axis=1, kind="stable")
    sorted_ring = np.take_along_axis(ring, by_ring, 1)
    place = np.arange(order.shape[1])
    begins = np.ones(ring.shape, dtype=bool)
    begins[:, 1:] = sorted_ring[:, 1:] != sorted_ring[:, :-1]
    nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
    step = np.empty(ring.shape, dtype=np.int32)
    np.put_along_axis(step, by_ring, (1 - 2 * (nth & 1)).astype(np.int32), 1)
    of_scaled = np.append(scaled, [False, False])[ring]  # -1 and -2 take the last two
    n_scaled = np.cumsum(np.where(of_scaled, step, 0), axis=1)
    n_own = np.cumsum(np.where(~of_scaled & (ring >= 0), step, 0), axis=1)
    in_box = np.cumsum((ring == -1).astype(np.int8) - (ring == -2), axis=1) > 0
    ends = here.copy()  # of the sides that lie on one another, the last
    with np.errstate(invalid="ignore"):
        ends[:, :-1] &= np.diff(x, axis=1) > tiny
    row, col = np.nonzero(ends)
    gap = (in_box & (n_scaled >= 2) & (n_own == 0))[row, col]
    before = np.zeros(len(gap), dtype=bool)
    before[1:] = gap[:-1] & (row[1:] == row[:-1])
    edge, starts, stops = order[row, col], gap & ~before, before & ~gap
    return row[starts], edge[starts], edge[stops]


def trapezoids(rings: list[np.ndarray], scaled: np.ndarray, box: tuple[float, float, float, float]) -> list[tuple[float, ...]]:
    """(y0, y1, l0, r0, l1, r1) of what in ``box`` lies in two scaled rings or more and in no other ring.

    Between neighbouring heights at which an edge begins, ends or crosses another one or a side of the box, edges keep their order from left to right; each ring is
    inside from its odd to its even edges there. Neighbouring stretches of a gap are taken together, and those between the same two edges are one piece.
    """
    xmin, ymin, xmax, ymax = box
    sides, owner = _sides(rings, ymin, ymax)
    walls = np.array([[xmin, ymin, xmin, ymax], [xmax, ymin, xmax, ymax]])
    sides, owner = np.concatenate([sides, walls]), np.concatenate([owner, [-1, -2]])
    heights = np.unique(np.concatenate([sides[:, 1], sides[:, 3], _crossings(sides, ymin, ymax), [ymin, ymax]]))
    heights = heights[(heights >= ymin) & (heights <= ymax)]
    keep = np.concatenate([[True], np.diff(heights) > TINY * (ymax - ymin)])
    heights = heights[keep]
    found, step = [], max(1, _AT_ONCE // len(sides))
    for i in range(0, len(heights) - 1, step):
        row, start, end = _gaps_at(sides, owner, scaled, (heights[i:i + step + 1][:-1] + heights[i:i + step + 1][1:]) / 2, TINY * (xmax - xmin))
        found.append((row + i, start, end))
    if not found:
        return []
    row, start, end = (np.concatenate(f) for f in zip(*found, strict=True))
    # the same pair of edges in neighbouring stretches is one piece; pieces come in the order in which they end
    order = np.lexsort((row, end, start))
    r, s, e = row[order], start[order], end[order]
    new = np.ones(len(r) + 1, dtype=bool)
    new[1:-1] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (r[1:] != r[:-1] + 1)
    first, last = order[new[:-1]], order[new[1:]]
    by_end = np.argsort(last)
    first, last = first[by_end], last[by_end]
    a, b = heights[row[first]], heights[row[last] + 1]
    left, right = sides[start[last]], sides[end[last]]
    l0, r0, l1, r1 = _x_at(left, a), _x_at(right, a), _x_at(left, b), _x_at(right, b)
    kept = np.maximum(r0 - l0, r1 - l1) > TINY * (xmax - xmin)
    pieces = np.stack([a, b, l0, np.maximum(l0, r0), l1, np.maximum(l1, r1)], axis=1)[kept]
    return [tuple(p) for p in pieces.tolist()]


def _touch(a: tuple[float, float], b: tuple[float, float], tiny: float) -> bool:
    return min(a[1], b[1]) - max(a[0], b[0]) > tiny


def _joined(pieces: list[tuple[float, ...]], tiny: float) -> list[int]:
    """A number for each piece, the same for pieces of the cell that share a stretch of their lower and upper sides."""
    up = list(range(len(pieces)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    below: dict[float, list[int]] = {}
    for i, p in enumerate(pieces):
        below.setdefault(p[1], []).append(i)
    for i, p in enumerate(pieces):
        for j in below.get(p[0], ()):
            if _touch(p[2:4], pieces[j][4:6], tiny):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(pieces))]


def _rings(column: pa.ChunkedArray) -> list[np.ndarray]:
    held = column.combine_chunks()
    points = held.flatten()
    xy = np.stack([points.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
    return np.split(xy, np.cumsum(held.value_lengths().to_numpy())[:-1])


def _swept(cell: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        scaled = group.column("scaled").to_numpy(zero_copy_only=False).astype(bool)
        low = {c: group.column(c + "0").to_numpy() for c in ("cx", "cy")}
        high = {c: group.column(c + "1").to_numpy() for c in ("cx", "cy")}
        rows: list[tuple] = []
        rings = _rings(group.column("ring")) if scaled.sum() >= 2 else []
        bx, by = (k.as_py() * BLOCK for k in key[-2:])
        for cx in range(bx, bx + BLOCK) if rings else ():
            for cy in range(by, by + BLOCK):
                held = np.flatnonzero((low["cx"] <= cx) & (cx <= high["cx"]) & (low["cy"] <= cy) & (cy <= high["cy"]))
                if scaled[held].sum() < 2:
                    continue
                pieces = trapezoids([rings[i] for i in held], scaled[held], (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell))
                rows += [(cx, cy, local, *piece) for local, piece in zip(_joined(pieces, TINY * cell * 1e3), pieces, strict=True)]
        names = [f.split()[0] for f in _PIECE.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 6]
        held = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
        own = {f: pa.array([key[i].as_py()] * len(rows), group.schema.field(f).type) for i, f in enumerate(group.column_names[: len(key) - 2])}
        return pa.table(own | held)

    return run


def gap_pieces(polygons: DataFrame, keys: list[str], k: float = 1.5, cell: float = CELL) -> DataFrame:
    """(keys, cx, cy, local, y0, y1, l0, r0, l1, r1): gaps between crowns as trapezoids, between the heights y0 and y1 and, at these, from l to r.

    A gap is what lies in two rings or more scaled by ``k`` and in no ring as it is: the union of all pairwise intersections minus all crowns, without pairs.
    Rings are simple; the overlay is exact up to rounding of doubles. A ring goes to the blocks of cells that its scaled box touches, a task sweeps the cells of a block one by one.
    """
    both = polygons.select(*keys, scale_ring("ring", k).alias("ring"), F.lit(True).alias("scaled")).unionByName(
        polygons.select(*keys, F.col("ring"), F.lit(False).alias("scaled")))
    box = bbox("ring")
    at = lambda side: F.floor(box[side] / F.lit(float(cell)))
    placed = both.withColumns({"cx0": at("xmin"), "cx1": at("xmax"), "cy0": at("ymin"), "cy1": at("ymax")})
    blocks = lambda c: F.explode(F.sequence(*[F.floor(F.col(c + end) / F.lit(BLOCK)) for end in "01"]))
    dealt = placed.withColumn("bx", blocks("cx")).withColumn("by", blocks("cy"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polygons.select(*keys).schema.fields)
    named = [*keys, "ring", "scaled", "cx0", "cx1", "cy0", "cy1", "bx", "by"]
    return dealt.select(*named).groupBy(*keys, "bx", "by").applyInArrow(_swept(cell), f"{fields}, {_PIECE}")


def _borders(pieces: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, line, low, high, node, side) of the stretches of pieces on the lines between cells; side 1 lies above or to the right of the line."""
    tiny = F.lit(TINY * cell * 1e3)
    x0, y0, s = F.col("cx") * F.lit(cell), F.col("cy") * F.lit(cell), F.lit(cell)
    on = lambda a, b: F.abs(a - b) <= tiny

    def stretch(line: Column, low: Column, high: Column, side: int, when: Column) -> Column:
        return F.when(when, F.struct(line.alias("line"), low.alias("low"), high.alias("high"), F.lit(side).alias("side")))

    name = lambda kind, cx, cy: F.concat_ws("/", F.lit(kind), cx.cast("string"), cy.cast("string"))
    cx, cy = F.col("cx"), F.col("cy")
    every = F.array_compact(F.array(
        stretch(name("h", cx, cy), F.col("l0"), F.col("r0"), 1, on(F.col("y0"), y0)),
        stretch(name("h", cx, cy + 1), F.col("l1"), F.col("r1"), 0, on(F.col("y1"), y0 + s)),
        stretch(name("v", cx, cy), F.col("y0"), F.col("y1"), 1, on(F.col("l0"), x0) & on(F.col("l1"), x0)),
        stretch(name("v", cx + 1, cy), F.col("y0"), F.col("y1"), 0, on(F.col("r0"), x0 + s) & on(F.col("r1"), x0 + s))))
    return pieces.select(*keys, "node", F.explode(every).alias("s")).select(*keys, "node", "s.*")


def gap_polygons(polygons: DataFrame, keys: list[str], k: float = 1.5, cell: float = CELL) -> DataFrame:
    """(keys, part, area, ring): ``gap_pieces`` as rings, with the single part that each belongs to and the area of the piece.

    Pieces that share a stretch of a side are one part, across cells too; ``part`` is the same number for them within ``keys``. The sum of the areas by part
    is the area of the gap polygon.
    """
    pieces = cut_lineage(gap_pieces(polygons, keys, k, cell).withColumn("node", F.xxhash64("cx", "cy", "local")))
    edge = _borders(pieces, keys, cell)
    left, right = edge.filter("side = 0"), edge.filter("side = 1").withColumnsRenamed({"low": "low2", "high": "high2", "node": "node2"}).drop("side")
    met = left.drop("side").join(right, [*keys, "line"]).filter(F.least("high", "high2") - F.greatest("low", "low2") > F.lit(TINY * cell * 1e3))
    roots = connect(met.select(*keys, F.col("node").alias("u"), F.col("node2").alias("v")).distinct(), keys)
    area = (F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2
    corner = lambda x, y: point(F.col(x), F.col(y))
    ring = F.array(corner("l0", "y0"), corner("r0", "y0"), corner("r1", "y1"), corner("l1", "y1"), corner("l0", "y0"))
    return pieces.join(roots, [*keys, "node"], "left").select(*keys, F.coalesce("root", "node").alias("part"), area.alias("area"), ring.alias("ring"))


def gap_parts(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, area, pieces) of ``gap_polygons``."""
    return gaps.groupBy(*keys, "part").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("pieces"))


def burn_gaps(gaps: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """(keys, row, col) of the pixels that a gap polygon reaches, corners at the pixel they lie in; rings are in pixel coordinates, ``sizes`` has keys, rows, cols."""
    snapped = F.transform("ring", lambda p: point(F.floor(p["x"]), F.floor(p["y"])))
    placed = gaps.join(sizes, keys).select(*keys, "rows", "cols", F.monotonically_increasing_id().alias("seq"), snapped.alias("ring"))
    return rasterize(cut_lineage(spread(placed, *keys, "seq")), keys, "seq", 1, 1).select(*keys, "row", "col")
