"""The cube of a volume that holds the most foreground, by Otsu's threshold and sliding sums over rows of bricks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.sources.volumes import COLUMNS, SCHEMA

C = F.col
BINS = 256


def _each(rows: pd.DataFrame):
    for bx, by, bz, nx, ny, nz, dtype, data in rows[COLUMNS].itertuples(index=False, name=None):
        yield (bx, by, bz), np.frombuffer(data, dtype).reshape(nz, ny, nx)


def _frame(bricks: list[tuple[tuple, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(*place, *a.shape[::-1], a.dtype.str, a.tobytes()) for place, a in bricks], columns=COLUMNS)


def sampled(bricks: DataFrame, brick: int, stride: int) -> DataFrame:
    """Bricks of every stride-th voxel along each axis; ``stride`` divides ``brick``, so bricks shrink by themselves."""
    if brick % stride:
        raise ValueError("the stride must divide the brick size")

    def run(batches):
        for b in batches:
            yield _frame([(place, np.ascontiguousarray(a[::stride, ::stride, ::stride], np.float64)) for place, a in _each(b)])

    return bricks.mapInPandas(run, SCHEMA)


def otsu(bricks: DataFrame) -> DataFrame:
    """One row: ``threshold``, the lower edge of the first of 256 bins with the largest variance between the two sides, and the range."""

    def ends(batches):
        for b in batches:
            yield pd.DataFrame([(a.min(), a.max()) for _, a in _each(b)], columns=["lo", "hi"])

    found = bricks.mapInPandas(ends, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if found["lo"] is None:
        raise ValueError("the volume has no bricks")
    lo, width = found["lo"], max(found["hi"] - found["lo"], 1e-300)

    def count(batches):
        for b in batches:
            n = np.zeros(BINS, np.int64)
            for _, a in _each(b):
                n += np.bincount(np.minimum(np.floor((a - lo) / width * BINS), BINS - 1).astype(int).ravel(), minlength=BINS)
            yield pd.DataFrame({"bin": np.flatnonzero(n), "n": n[n > 0]})

    h = bricks.mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    moment = C("n") * (C("bin") + 0.5)
    # At most 256 rows meet.
    upto, whole = Window.orderBy("bin"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = h.select("bin", *[F.sum(v).over(w).cast("double").alias(name) for name, v, w in (("w", "n", upto), ("m", moment, upto), ("wt", "n", whole), ("mt", moment, whole))])
    between = F.round(F.pow(C("mt") * C("w") - C("m") * C("wt"), 2) / F.greatest(C("w") * (C("wt") - C("w")), F.lit(1.0)), 3)
    return sums.agg(F.min_by("bin", F.struct(-between, C("bin"))).alias("bin")).select((F.lit(lo) + C("bin") * F.lit(width) / BINS).alias("threshold"))


def _slide(axis: int, cube: int):
    """Sums over ``cube`` voxels along ``axis`` (0 is x) of one row of bricks."""
    along = 2 - axis  # arrays are z, y, x

    def slide(rows: pd.DataFrame) -> pd.DataFrame:
        held = sorted(_each(rows), key=lambda r: r[0][axis])
        line = np.concatenate([a for _, a in held], axis=along).astype(np.int64)
        total = np.cumsum(np.insert(line, 0, 0, axis=along), axis=along)
        n = line.shape[along] - cube + 1
        sums = np.take(total, np.arange(cube, cube + n), axis=along) - np.take(total, np.arange(n), axis=along)
        out, at = [], 0
        for place, a in held:
            piece = np.take(sums, np.arange(at, min(at + a.shape[along], n)), axis=along)
            at += a.shape[along]
            if piece.size:
                out.append((place, np.ascontiguousarray(piece)))
        return _frame(out)

    return slide


def window_sums(bricks: DataFrame, side: int, shape: tuple[int, int, int]) -> DataFrame:
    """Sums over the cubes of ``side`` voxels from each voxel on that lie in the volume; other places are left out.

    One axis after the other: a row of bricks along it is put together, summed up and taken apart again, so a task holds a
    row of bricks, which grows with the length of the volume only. ``shape``: x, y, z of these bricks' voxels.
    """
    for axis, name in enumerate("xyz"):
        others = [f"b{a}" for a in "xyz" if a != name]
        bricks = bricks.groupBy(*others).applyInPandas(_slide(axis, min(side, shape[axis])), SCHEMA)
    return bricks


def choose_crop(bricks: DataFrame, shape: tuple[int, int, int], brick: int, size: int, stride: int) -> DataFrame:
    """One row: x, y, z of the cube of side ``size`` with the most voxels above the threshold, their count in the sample, and the threshold.

    Only every stride-th voxel is looked at. Of equal cubes the first by z, y, x is taken; a cube longer than the volume is cut.
    """
    few = sampled(bricks, brick, stride)
    sub = tuple(-(-n // stride) for n in shape)
    limit = otsu(few).first()["threshold"]  # one number
    step = brick // stride

    def above(batches):
        for b in batches:
            yield _frame([(place, (a > limit).astype(np.int64)) for place, a in _each(b)])

    def best(batches):
        for b in batches:
            rows = []
            for (bx, by, bz), a in _each(b):
                z, y, x = np.unravel_index(int(a.argmax()), a.shape)
                rows.append((int(a.max()), int(z + bz * step), int(y + by * step), int(x + bx * step)))
            yield pd.DataFrame(rows, columns=["n", "z", "y", "x"])

    sums = window_sums(few.mapInPandas(above, SCHEMA), max(size // stride, 1), sub)
    top = sums.mapInPandas(best, "n long, z long, y long, x long").agg(F.min_by(F.struct("x", "y", "z", "n"), F.struct(-C("n"), "z", "y", "x")).alias("r"))
    at = [F.least(C(f"r.{a}") * stride, F.greatest(F.lit(n - size), F.lit(0))).cast("long").alias(a) for a, n in zip("xyz", shape, strict=True)]
    return top.select(*at, C("r.n").alias("n"), F.lit(limit).alias("threshold"))
