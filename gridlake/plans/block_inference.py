"""Inference on block arrays: several Python models with bands of their own, no pixel row between reading and writing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.bands import EPSILON
from ..operators.mosaic import OPERATORS, start_value
from ..operators.scoring import Scorer
from ..schemas import floor_div


@dataclass(frozen=True)
class BandModel:
    """A network and the bands it takes; ``load`` runs once per group of windows, on the executor.

    With ``half_bands`` the scorer gets a second array, the window at half the resolution.
    """

    name: str
    bands: tuple[str, ...]
    load: Callable[[], Scorer]
    half_bands: tuple[str, ...] = ()


def finer(values: np.ndarray, first: tuple[int, int], extent: tuple[int, int], start: tuple[int, int], count: tuple[int, int], factor: int) -> np.ndarray:
    """Bilinear samples of an image of ``extent``, of which ``values`` holds a piece from ``first`` on: ``factor`` for each pixel, centres aligned, edges repeated.

    The samples are those of the pixels from ``start`` on, ``count`` of them, by axis.
    """
    out = values
    for axis in (0, 1):
        at = (np.arange(start[axis] * factor, (start[axis] + count[axis]) * factor) + 0.5) / factor - 0.5
        at = np.clip(at, 0, extent[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, extent[axis] - 1)
        share = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low - first[axis], axis) * (1 - share) + np.take(out, high - first[axis], axis) * share
    return out


def coarser(values: np.ndarray, factor: int) -> np.ndarray:
    """Means over cells of the two last axes."""
    *head, h, w = values.shape
    return values.reshape(*head, h // factor, factor, w // factor, factor).mean(axis=(-3, -1))


@dataclass(frozen=True)
class _Run:
    models: tuple[BandModel, ...]
    bands: tuple[str, ...]
    half_bands: tuple[str, ...]
    heads: tuple[str, ...]
    size: int
    width: int
    height: int
    stride: int
    op: str
    border: int
    normalize: bool
    batch: int
    start: float
    each: bool
    up: int
    coarse: int  # pixels of the image that a pixel of the canvas is wide

    @property
    def rim(self) -> int:
        return int(self.up > 1)

    @property
    def tags(self) -> list[str]:
        return [m.name for m in self.models] if self.each else [""]

    def assemble(self, group: pa.Table, r0: int, c0: int, scale: int, bands: tuple[str, ...], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, present) of the blocks around one block, from (r0, c0) on, at the resolution of the bands."""
        high, wide = (self.size + self.height) // scale + 2 * self.rim, (self.size + self.width) // scale + 2 * self.rim
        values, present = np.zeros((high, wide, len(bands))), np.zeros((high, wide), dtype=bool)
        for i in range(group.num_rows):
            if not group.column(f"{prefix}rows")[i].is_valid:
                continue
            r = group.column(f"{prefix}rows")[i].values.to_numpy() - r0
            c = group.column(f"{prefix}cols")[i].values.to_numpy() - c0
            near = (r >= 0) & (c >= 0) & (r < high) & (c < wide)
            r, c = r[near], c[near]
            present[r, c] = True
            for k, b in enumerate(bands):
                values[r, c, k] = group.column(f"{prefix}{b}")[i].values.to_numpy(zero_copy_only=False)[near]
        return values, present

    def windows(self, r0: int, c0: int, rows: int, cols: int) -> list[tuple[int, int, int, int]]:
        """(row, column, height, width) of the windows that begin in a block, column by column."""
        first = lambda at: -(-at // self.stride) * self.stride
        return [
            (r, c, min(self.height, rows - r), min(self.width, cols - c))
            for c in range(first(c0), min(c0 + self.size, cols), self.stride) for r in range(first(r0), min(r0 + self.size, rows), self.stride)]

    def patch(self, values: np.ndarray, present: np.ndarray, scale: int, normalize: bool) -> np.ndarray:
        """One window, by its own mean and deviation if asked, zeros around it; ``scale`` is 2 at half the resolution."""
        out = np.zeros((self.height * self.up // scale, self.width * self.up // scale, values.shape[-1]))
        x = values
        if normalize and present.any():
            inside = values[present]
            x = (values - inside.mean(axis=0)) / (inside.std(axis=0) + EPSILON)
            x[~present] = 0.0
        out[: x.shape[0], : x.shape[1]] = x
        return out

    def scored(self, patches: np.ndarray, halves: np.ndarray | None, scorers: list[Scorer]) -> np.ndarray:
        """(tag, head, n, height, width): each model's heads, or their mean over the models whose score is no number's absence."""
        every = []
        for model, scorer in zip(self.models, scorers, strict=True):
            given = [patches[..., [self.bands.index(b) for b in model.bands]]]
            if model.half_bands:
                given.append(halves[..., [self.half_bands.index(b) for b in model.half_bands]])
            every.append(np.stack([np.asarray(h, dtype=float) for h in scorer(*given)[: len(self.heads)]]))
        stacked = np.stack(every)
        if self.up > 1:
            stacked = coarser(stacked, self.up)
            for k, head in enumerate(self.heads):
                if head == "dens":
                    stacked[:, k] *= self.up * self.up  # its sum over the window stays
        if self.each:
            return stacked
        known = ~np.isnan(stacked)
        n = known.sum(axis=0)
        return np.where(n > 0, np.where(known, stacked, 0.0).sum(axis=0) / np.maximum(n, 1), np.nan)[None]

    def score(self, key: tuple, group: pa.Table) -> pa.Table:
        """Scores the windows that begin in one block; a row for each block that they reach, and for the block itself."""
        image, own_row, own_col = (k.as_py() for k in key)
        rows, cols = group.column("img_rows")[0].as_py(), group.column("img_cols")[0].as_py()
        r0, c0, k = own_row * self.size, own_col * self.size, self.coarse
        high, wide = self.size + self.height, self.size + self.width
        values, present = self.assemble(group, r0 - self.rim, c0 - self.rim, 1, self.bands, "")
        if self.up > 1:
            there = (max(0, min(high, rows - r0)), max(0, min(wide, cols - c0)))
            first = (r0 - self.rim, c0 - self.rim)
            present = present[self.rim : self.rim + high, self.rim : self.rim + wide]
            values = finer(values, first, (rows, cols), (r0, c0), there, self.up) if min(there) else values[:0]
        half, half_present = self.assemble(group, r0 // 2, c0 // 2, 2, self.half_bands, "half_") if self.half_bands else (None, None)
        todo = self.windows(r0, c0, rows, cols)
        scorers = [m.load() for m in self.models] if todo else []
        canvas = (high // k, wide // k)
        seen = present.reshape(canvas[0], k, canvas[1], k).any(axis=(1, 3))
        merged = np.full((len(self.tags), len(self.heads), *canvas), self.start)
        order = np.full(canvas, -1, dtype=np.int64)
        slices: list[tuple] = []
        for at in range(0, len(todo), self.batch):
            part = todo[at : at + self.batch]
            u = self.up
            patches, halves = [], []
            for r, c, h, w in part:
                a, b = slice((r - r0) * u, (r - r0 + h) * u), slice((c - c0) * u, (c - c0 + w) * u)
                here = present[r - r0 : r - r0 + h, c - c0 : c - c0 + w]
                patches.append(self.patch(values[a, b], here.repeat(u, 0).repeat(u, 1), 1, self.normalize))
                if half is not None:
                    a, b = slice((r - r0) // 2, -(-(r - r0 + h) // 2)), slice((c - c0) // 2, -(-(c - c0 + w) // 2))
                    halves.append(self.patch(half[a, b], half_present[a, b], 2, False))
            heads = self.scored(np.stack(patches), np.stack(halves) if halves else None, scorers)
            for i, (r, c, h, w) in enumerate(part):
                h, w = -(-h // k), -(-w // k)
                new, n = heads[:, :, i, :h, :w].copy(), self.border
                if n:
                    edge = np.ones((h, w), dtype=bool)
                    edge[n : h - n, n : w - n] = False
                    new[:, :, edge] = 0.0
                a, b = slice((r - r0) // k, (r - r0) // k + h), slice((c - c0) // k, (c - c0) // k + w)
                if self.op == "MIX":
                    slices.append(((c << 32) | r, a, b, new))
                    continue
                old = merged[:, :, a, b]
                merged[:, :, a, b] = np.maximum(old, new) if self.op == "MAX" else np.minimum(old, new) if self.op == "MIN" else new
                order[a, b] = (c << 32) | r
        out: dict[str, list] = {n: [] for n in (*_KEYS, "rows", "cols", *self.heads, "order")}
        side = self.size // k

        def give(br: int, bc: int, r: np.ndarray, c: np.ndarray, found: np.ndarray, at: np.ndarray) -> None:
            for t, tag in enumerate(self.tags):
                row = (image, tag, r0 // self.size + br, c0 // self.size + bc, r + r0 // k, c + c0 // k, *found[t], at)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)

        for br in range(-(-canvas[0] // side)):
            for bc in range(-(-canvas[1] // side)):
                cut = (slice(br * side, (br + 1) * side), slice(bc * side, (bc + 1) * side))
                r, c = np.nonzero(seen[cut] & ((order[cut] >= 0) | (br + bc == 0)))
                r, c = r + br * side, c + bc * side
                if len(r):
                    give(br, bc, r, c, merged[:, :, r, c], order[r, c] if self.op != "MIX" else np.array([-1]))
                for place, a, b, new in slices:
                    top, left = max(a.start, cut[0].start), max(b.start, cut[1].start)
                    low, right = min(a.stop, cut[0].stop), min(b.stop, cut[1].stop)
                    if top < low and left < right:
                        r, c = np.nonzero(seen[top:low, left:right])
                        if len(r):
                            give(br, bc, r + top, c + left, new[:, :, r + top - a.start, c + left - b.start], np.array([place]))
        return self.table(out)

    def merge(self, key: tuple, pieces: pa.Table) -> pa.Table:
        """One block from what the windows that reach it have left; for MIX these are the windows' slices, folded in the windows' order."""
        image, tag, block_row, block_col = (k.as_py() for k in key)
        side = self.size // self.coarse
        merged = np.full((len(self.heads), side, side), self.start)
        order = np.full((side, side), -2, dtype=np.int64)
        turn = range(pieces.num_rows)
        if self.op == "MIX":
            turn = np.argsort([pieces.column("order")[i][0].as_py() for i in turn], kind="stable").tolist()
        for i in turn:
            r, c = (pieces.column(n)[i].values.to_numpy() - k * side for n, k in (("rows", block_row), ("cols", block_col)))
            at = pieces.column("order")[i].values.to_numpy()
            new = np.stack([pieces.column(h)[i].values.to_numpy() for h in self.heads])
            if self.op == "MIX":
                if at[0] >= 0:
                    old = merged[:, r, c]
                    mixed = np.where(old != 0, old * 0.5 + new * 0.5, old)
                    merged[:, r, c] = np.where(mixed == 0, new, mixed)
            elif self.op == "REPLACE":
                later = at > order[r, c]
                merged[:, r[later], c[later]] = new[:, later]
            else:
                merged[:, r, c] = (np.maximum if self.op == "MAX" else np.minimum)(merged[:, r, c], new)
            order[r, c] = np.maximum(order[r, c], at)
        r, c = np.nonzero(order > -2)
        row = (image, tag, block_row, block_col, r + block_row * side, c + block_col * side, *merged[:, r, c])
        return self.table({n: [v] for n, v in zip((*_KEYS, "rows", "cols", *self.heads), row, strict=True)})

    def table(self, columns: dict[str, list]) -> pa.Table:
        kinds = _KEYS | {"rows": pa.list_(pa.int32()), "cols": pa.list_(pa.int32()), "order": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, type=kinds.get(n, pa.list_(pa.float64()))) for n, v in columns.items()})

    @property
    def schema(self) -> str:
        return ", ".join(["image_id long, model_id string, block_row int, block_col int, rows array<int>, cols array<int>", *[f"{h} array<double>" for h in self.heads]])


_KEYS = {"image_id": pa.int64(), "model_id": pa.string(), "block_row": pa.int32(), "block_col": pa.int32()}


def score_blocks(
    blocks: DataFrame, images: DataFrame, models: list[BandModel], size: int, width: int, height: int, stride: int, op: str = "MAX",
    border: int = 0, normalize: bool = True, batch: int = 16, init: float = 0.0, half_blocks: DataFrame | None = None,
    heads: tuple[str, ...] = ("seg", "dens"), each_model: bool = False, upscale: int = 1, half_canvas: bool = False,
) -> DataFrame:
    """Blocks (as of ``to_blocks``, of side ``size``) with the merged heads of an ensemble instead of the bands.

    A block is copied to the blocks in which the windows begin that reach it, so a task holds one block and a window's rim beyond it,
    whatever the size of the image. There windows are cut as array slices, normalised by their own statistics, scored by each model on
    its own bands in batches, averaged without the models that gave NaN, and merged; what they leave goes to the blocks they reach and is merged
    once more. Two shuffles of arrays, no row for a pixel. MAX, MIN and REPLACE merge before the second one; MIX depends on
    every value in order, so there each window's slice travels. Pixels between windows keep the canvas's first value.

    ``half_blocks`` has the same blocks at half the resolution, of side ``size`` / 2, for models with ``half_bands`` (given as they are). With ``half_canvas`` the heads
    come at half the resolution and so does the result. ``each_model`` keeps one result a model, with ``model_id``. With ``upscale`` the image is sampled that much
    finer, beyond the window's border too, windows are normalised and scored there, and scores go back as means, ``dens`` so that its sum stays.
    """
    if op not in OPERATORS:
        raise ValueError(f"blocks are merged by one of {OPERATORS}")
    bands = tuple(sorted({b for m in models for b in m.bands}))
    half_bands = tuple(sorted({b for m in models for b in m.half_bands}))
    if half_bands and half_blocks is None:
        raise ValueError("models ask for bands at half the resolution: give half_blocks")
    if (half_bands or half_canvas) and any(x % 2 for x in (size, width, height, stride)):
        raise ValueError("block, window and stride must be even where half the resolution is asked for")
    if upscale > 1 and (half_bands or half_canvas):
        raise ValueError("finer sampling and half the resolution exclude each other")
    run = _Run(tuple(models), bands, half_bands, heads, size, width, height, stride, op, border, normalize, batch, start_value(op, init),
               each_model, upscale, 2 if half_canvas else 1)

    def owners(block: str, reach: int, extent: str):
        first = F.greatest(F.lit(0), floor_div(F.col(block) * size - reach - run.rim + 1, size))
        last = F.least(F.col(block) + 1, F.greatest(F.col(block), floor_div(F.col(extent) - 1, size))) if run.rim else F.col(block)
        return F.explode(F.sequence(first, last))

    sized = images.select("image_id", F.col("rows").alias("img_rows"), F.col("cols").alias("img_cols"))
    spread = blocks.select("image_id", "block_row", "block_col", "rows", "cols", *bands)
    if half_bands:
        half = half_blocks.select("image_id", "block_row", "block_col", *[F.col(c).alias(f"half_{c}") for c in ("rows", "cols", *half_bands)])
        spread = spread.join(half, ["image_id", "block_row", "block_col"], "left")
    spread = spread.join(sized, "image_id")
    spread = spread.withColumn("own_row", owners("block_row", height, "img_rows")).withColumn("own_col", owners("block_col", width, "img_cols"))
    pieces = spread.groupBy("image_id", "own_row", "own_col").applyInArrow(lambda key, group: run.score(key, group), run.schema + ", order array<bigint>")
    merged = pieces.groupBy("image_id", "model_id", "block_row", "block_col").applyInArrow(lambda key, group: run.merge(key, group), run.schema)
    return merged if each_model else merged.drop("model_id")


def score_height_blocks(
    blocks: DataFrame, half_blocks: DataFrame, images: DataFrame, models: list[BandModel], size: int, width: int, height: int, stride: int,
    op: str = "MIX", **options,
) -> DataFrame:
    """Blocks of side ``size`` / 2 with ``height`` at half the resolution, from models that take both resolutions and give one head at half of it."""
    return score_blocks(
        blocks, images, models, size, width, height, stride, op, half_blocks=half_blocks, heads=("height",), half_canvas=True, **options)
