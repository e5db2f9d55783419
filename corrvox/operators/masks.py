"""Masks of volumes: smoothing, opening, labels of connected voxels, the largest part, holes.

A mask is a table of bricks of 0 and 1. What needs a voxel's neighbourhood gets each brick with a margin of its neighbours'
voxels (a brick sends each neighbour the slab it needs: one shuffle, 27 small pieces meet). Labels are made inside bricks;
bricks then meet only by the voxels of their faces, as a relation of labels whose connected components name the parts. A
task never holds more than a brick and its margin, and no label table is collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrvox.functions.kernels import gaussian
from corrvox.operators.components import components
from corrvox.operators.quantiles import quantiles
from corrvox.sources.volumes import COLUMNS, SCHEMA, voxel_rows

C = F.col
Cut = Callable[[DataFrame], DataFrame]
PLACE = ["bx", "by", "bz"]


def _bricks(rows: pd.DataFrame):
    for *place, nx, ny, nz, dtype, data in rows[COLUMNS].itertuples(index=False, name=None):
        yield tuple(place), np.frombuffer(data, dtype).reshape(nz, ny, nx)


def _frame(found) -> pd.DataFrame:
    return pd.DataFrame([(*place, *a.shape[::-1], a.dtype.str, np.ascontiguousarray(a).tobytes()) for place, a in found], columns=COLUMNS)


def _few(batches, most: int = 64):
    """The frames in pieces: a batch may hold thousands of bricks, and what is made of a brick is many times its size."""
    for b in batches:
        for k in range(0, len(b), most):
            yield b.iloc[k : k + most]


def each_brick(bricks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches):
        for b in _few(batches):
            yield _frame((place, f(a)) for place, a in _bricks(b))

    return bricks.mapInPandas(run, SCHEMA)


def with_margin(bricks: DataFrame, shape: tuple[int, int, int], brick: int, margin: int, border: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Bricks of ``f(a)``, where ``a`` is a brick with ``margin`` voxels around it and ``f`` keeps its shape.

    Outside the volume there are zeros (``border`` "constant") or the image again (numpy's pad modes). ``margin`` is at most ``brick``.
    """
    if margin > brick:
        raise ValueError("the margin must not be longer than a brick")
    counts = [-(-n // brick) for n in shape]

    def send(batches):
        for b in _few(batches):
            out = []
            for place, a in _bricks(b):
                for step in product((-1, 0, 1), repeat=3):
                    to = tuple(p + s for p, s in zip(place, step, strict=True))
                    if all(0 <= t < n for t, n in zip(to, counts, strict=True)):
                        # The neighbour on the left needs the first voxels, the one on the right the last.
                        piece = a[tuple(slice(None, margin) if s < 0 else slice(max(0, n - margin), None) if s > 0 else slice(None) for s, n in zip(step[::-1], a.shape, strict=True))]
                        out.append((*to, *[-s for s in step], *piece.shape[::-1], piece.dtype.str, np.ascontiguousarray(piece).tobytes()))
            yield pd.DataFrame(out, columns=[*PLACE, "dx", "dy", "dz", "nx", "ny", "nz", "dtype", "data"])

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = [min(brick, n - int(k) * brick) for k, n in zip(key, shape, strict=True)][::-1]
        left = [margin if k else 0 for k in key][::-1]
        right = [min(margin, n - (int(k) + 1) * brick) if (int(k) + 1) * brick < n else 0 for k, n in zip(key, shape, strict=True)][::-1]
        whole = np.zeros([p + n + q for p, n, q in zip(left, size, right, strict=True)], rows["dtype"].iloc[0])
        for dx, dy, dz, nx, ny, nz, dtype, data in rows[["dx", "dy", "dz", "nx", "ny", "nz", "dtype", "data"]].itertuples(index=False, name=None):
            at = [(slice(p - m, p) if s < 0 else slice(p + n, p + n + m) if s > 0 else slice(p, p + n)) for s, m, p, n in zip((dz, dy, dx), (nz, ny, nx), left, size, strict=True)]
            whole[tuple(at)] = np.frombuffer(data, dtype).reshape(nz, ny, nx)
        fill = [(margin - p, margin - q) for p, q in zip(left, right, strict=True)]
        done = f(np.pad(whole, fill, mode=border))
        return _frame([(tuple(int(k) for k in key), done[tuple(slice(margin, margin + n) for n in size)])])

    sent = bricks.mapInPandas(send, "bx int, by int, bz int, dx int, dy int, dz int, nx int, ny int, nz int, dtype string, data binary")
    return sent.groupBy(*PLACE).applyInPandas(gather, SCHEMA)


def _shrunk(a: np.ndarray) -> np.ndarray:
    """Voxels that are set with all six neighbours; nothing is outside."""
    p = np.pad(a, 1)
    out = a.copy()
    for axis in range(3):
        for s in (0, 2):
            out &= np.take(p, np.arange(s, s + a.shape[axis]), axis=axis)[tuple(slice(1, -1) if k != axis else slice(None) for k in range(3))]
    return out


def _grown(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1)
    out = a.copy()
    for axis in range(3):
        for s in (0, 2):
            out |= np.take(p, np.arange(s, s + a.shape[axis]), axis=axis)[tuple(slice(1, -1) if k != axis else slice(None) for k in range(3))]
    return out


def opening(mask: DataFrame, shape: tuple[int, int, int], brick: int, times: int) -> DataFrame:
    """Shrunk ``times`` and grown again by as much, over faces; what is outside the volume is not set."""

    def f(a: np.ndarray) -> np.ndarray:
        for step in [_shrunk] * times + [_grown] * times:
            a = step(a)
        return a

    return with_margin(mask, shape, brick, 2 * times, "constant", f)


def local_labels(a: np.ndarray) -> np.ndarray:
    """For each set voxel the flat index of the first voxel of its part inside the array (faces touch), else -1."""
    flat = np.arange(a.size).reshape(a.shape)
    label = np.arange(a.size)
    ends = [(flat[lo][both], flat[hi][both]) for lo, hi in (((slice(None, -1),), (slice(1, None),)), ((slice(None), slice(None, -1)), (slice(None), slice(1, None))), ((..., slice(None, -1)), (..., slice(1, None)))) for both in [(a[lo] != 0) & (a[hi] != 0)]]
    x, y = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while ((up := label[label]) != label).any():
            label = up
    return np.where(a.ravel() != 0, label, -1).reshape(a.shape)


def parts(mask: DataFrame, shape: tuple[int, int, int], brick: int, cut: Cut) -> DataFrame:
    """(bx, by, bz, local, label, part, voxels, border) of the parts inside each brick: ``part`` names the connected part of the whole
    mask by its smallest label, ``border``: it reaches the volume's border. Voxels touch by faces."""
    counts = [-(-n // brick) for n in shape]

    def first(place) -> int:
        return ((place[2] * counts[1] + place[1]) * counts[0] + place[0]) * brick**3

    def inside(batches):
        for b in _few(batches):
            rows = []
            for place, a in _bricks(b):
                label = local_labels(a)
                names, n = np.unique(label[label >= 0], return_counts=True)
                edge = np.zeros(a.shape, bool)
                for axis, (k, m) in enumerate(zip(place[::-1], shape[::-1], strict=True)):
                    hits = [i for i, v in ((0, 0), (a.shape[axis] - 1, m - 1)) if k * brick + i == v]
                    edge[tuple(hits if j == axis else slice(None) for j in range(3))] = True
                at_edge = set(np.unique(label[edge & (label >= 0)]).tolist())
                rows += [(*place, int(k), first(place) + int(k), int(c), int(k) in at_edge) for k, c in zip(names, n, strict=True)]
            yield pd.DataFrame(rows, columns=[*PLACE, "local", "label", "voxels", "border"])

    def faces(batches):
        """A face's set voxels as (axis, the cell on its lower side, label), from both sides."""
        for b in _few(batches):
            out = []
            for place, a in _bricks(b):
                label = local_labels(a)
                for axis in range(3):
                    for upper, i in ((False, a.shape[axis] - 1), (True, 0)):
                        here = np.argwhere(np.take(label, [i], axis=axis) >= 0)
                        here[:, axis] = i
                        cell = here + np.array(place[::-1]) * brick
                        cell[:, axis] -= upper
                        z, y, x = cell.T
                        out.append(pd.DataFrame({"axis": axis, "x": x, "y": y, "z": z, "upper": upper, "label": first(place) + label[tuple(here.T)]}))
            yield pd.concat(out) if out else pd.DataFrame({k: [] for k in ("axis", "x", "y", "z", "upper", "label")})

    mask = cut(mask)
    own = cut(mask.mapInPandas(inside, "bx int, by int, bz int, local long, label long, voxels long, border boolean"))
    sides = mask.mapInPandas(faces, "axis int, x long, y long, z long, upper boolean, label long")
    key = ["axis", "x", "y", "z"]
    links = sides.where("not upper").select(*key, C("label").alias("a")).join(sides.where("upper").select(*key, C("label").alias("b")), key).select("a", "b").distinct()
    found = components(links, cut)
    return own.join(found, own["label"] == found["node"], "left").withColumn("part", F.coalesce("component", "label")).drop("node", "component")


def label_bricks(mask: DataFrame, shape: tuple[int, int, int], brick: int) -> DataFrame:
    """Bricks of the labels that ``parts`` gives inside bricks, -1 where nothing is set."""
    counts = [-(-n // brick) for n in shape]

    def run(batches):
        for b in _few(batches):
            out = []
            for place, a in _bricks(b):
                label = local_labels(a)
                base = ((place[2] * counts[1] + place[1]) * counts[0] + place[0]) * brick**3
                out.append((place, np.where(label < 0, -1, label + base)))
            yield _frame(out)

    return mask.mapInPandas(run, SCHEMA)


def keep_parts(mask: DataFrame, named: DataFrame, fill: bool = False) -> DataFrame:
    """Only the parts in ``named`` (bx, by, bz, local); with ``fill`` a mask of what is not set or is among them."""
    lists = named.groupBy(*PLACE).agg(F.collect_list("local").alias("held"))  # no more than a brick's parts

    def run(batches):
        for b in _few(batches):
            out = []
            for (place, a), held in zip(_bricks(b), b["held"], strict=True):
                chosen = np.isin(local_labels(a), [] if held is None else held)
                out.append((place, ((a == 0) | chosen if fill else chosen).astype(np.uint8)))
            yield _frame(out)

    return mask.join(lists, PLACE, "left").select(*COLUMNS, "held").mapInPandas(run, SCHEMA)


def largest(mask: DataFrame, shape, brick: int, cut: Cut) -> DataFrame:
    """The part with most voxels (ties: the smallest label)."""
    mask = cut(mask)
    named = cut(parts(mask, shape, brick, cut))
    top = named.groupBy("part").agg(F.sum("voxels").alias("n")).agg(F.min_by("part", F.struct(-C("n"), C("part"))).alias("part"))
    return keep_parts(mask, named.join(F.broadcast(top), "part"))  # one row


def filled(mask: DataFrame, shape, brick: int, cut: Cut) -> DataFrame:
    """With the holes set: parts of what isn't set that don't reach the volume's border."""
    empty = cut(each_brick(mask, lambda a: (a == 0).astype(np.uint8)))
    named = cut(parts(empty, shape, brick, cut))
    open_ = named.where("border").select("part").distinct()
    return keep_parts(empty, named.join(open_, "part", "left_anti"), fill=True)


def sample_mask(bricks: DataFrame, shape: tuple[int, int, int], brick: int, cut: Cut, sigma: float = 3.0, times: int = 2) -> DataFrame:
    """The specimen of a scan: the smoothed image above the middle of its 5th and 75th hundredth, opened, its largest part, without holes."""
    reach = math.ceil(4 * sigma)
    smooth = cut(with_margin(bricks, shape, brick, reach, "symmetric", lambda a: gaussian(a.astype(float), sigma)))
    q = quantiles(voxel_rows(smooth, brick), [], "v", {"low": 0.05, "high": 0.75}, cut).first()
    limit = 0.5 * (q["low"] + q["high"])
    mask = opening(each_brick(smooth, lambda a: (a > limit).astype(np.uint8)), shape, brick, times)
    return filled(largest(mask, shape, brick, cut), shape, brick, cut)
