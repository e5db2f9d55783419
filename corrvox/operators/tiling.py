"""Tiles of points, the image boxes they need, and how tiles are shared out."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def tile_of(points: DataFrame, size: float) -> DataFrame:
    return points.select("*", *[F.floor(C(a) / size).cast("int").alias(f"t{a}") for a in "xyz"])


def parted(dealt: DataFrame, key: list[str], most: int = 2048, copies: int = 4096) -> DataFrame:
    """``dealt`` with ``part``: tiles of more than ``most`` points are dealt over parts by place, so that copies of a point meet,
    but of a place's points no more than about ``copies`` do. Seeds have no say: they may be computed anew, places are stored."""
    n = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(C("_n") > most).select(*[C(k).alias(f"_{k}") for k in key], "_n")
    on = [C(k) == C(f"_{k}") for k in key]
    piles = F.ceil(C("_n") / copies).cast("long")
    part = F.pmod(F.xxhash64("x", "y", "z", F.pmod(F.xxhash64("point_id"), piles)), F.ceil(C("_n") / most).cast("long"))
    return dealt.join(n, on, "left").select(*dealt.columns, F.coalesce(part, F.lit(0).cast("long")).cast("int").alias("part"))


def plan(points: DataFrame, size: float, halo: float, cost_per_point: float) -> DataFrame:
    """``plan_dealt`` for tiles of a fixed size."""
    return plan_dealt(tile_of(points, size), halo, cost_per_point)


def plan_dealt(p: DataFrame, halo: float, cost_per_point: float, key: tuple[str, ...] = ("tx", "ty", "tz")) -> DataFrame:
    """A row for each tile (``key``) of points (with seeds su, sv, sw): count, the boxes to read in both images, cost.

    The reference box holds the points and the halo. The deformed box is that box moved by the median
    seed, grown by how far any seed is from the median. The median needs the tile's points before the
    spread does, so two aggregations; both have one row for each tile.
    """
    one = p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"), *[F.min(a).alias(f"min_{a}") for a in "xyz"], *[F.max(a).alias(f"max_{a}") for a in "xyz"],
        *[F.percentile(f"s{c}", F.lit(0.5)).alias(f"mid_{c}") for c in "uvw"], *[F.min(f"s{c}").alias(f"low_{c}") for c in "uvw"], *[F.max(f"s{c}").alias(f"high_{c}") for c in "uvw"],
    )
    grow = F.ceil(F.lit(float(halo)))
    cols = []
    for a, c in zip("xyz", "uvw", strict=True):
        lo, hi = F.ceil(f"min_{a}") - grow, F.floor(f"max_{a}") + 1 + grow
        # Every seed lies between the least and the greatest, so the largest distance from the median is at an end.
        spread = F.ceil(F.greatest(C(f"high_{c}") - C(f"mid_{c}"), C(f"mid_{c}") - C(f"low_{c}")))
        cols += [lo.alias(f"ref_{a}_lo"), hi.alias(f"ref_{a}_hi"), (F.floor(lo + C(f"mid_{c}")) - spread).alias(f"def_{a}_lo"), (F.ceil(hi + C(f"mid_{c}")) + spread).alias(f"def_{a}_hi")]
    return one.select(*key, "n_points", *cols, (C("n_points") * cost_per_point).alias("cost"))


def largest_task(tiles: DataFrame, bytes_per_voxel: int) -> DataFrame:
    """One row: the tile whose two images take most (tx, ty, tz, n_points, bytes); none without tiles."""
    sides = {p: [F.greatest(C(f"{p}_{a}_hi") - C(f"{p}_{a}_lo"), F.lit(0)).cast("double") for a in "xyz"] for p in ("ref", "def")}
    voxels = sum((s[0] * s[1] * s[2] for s in sides.values()), F.lit(0.0))
    rows = tiles.select("tx", "ty", "tz", "n_points", (voxels * bytes_per_voxel).alias("bytes"))
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct("bytes", "tx", "ty", "tz")).alias("r")).where("r is not null").select("r.*")


def bricks_of(boxes: DataFrame, brick: int, prefix: str, shape: tuple[int, int, int]) -> DataFrame:
    """The box-overlap join as an equi-join: the brick indices that each box covers inside the volume (x, y, z)."""
    out = boxes
    for a, n in zip("xyz", shape, strict=True):
        lo, hi = F.greatest(C(f"{prefix}_{a}_lo"), F.lit(0)), F.least(C(f"{prefix}_{a}_hi"), F.lit(n))
        some = F.sequence(F.floor(lo / brick).cast("int"), F.floor((hi - 1) / brick).cast("int"))
        out = out.select("*", F.explode(F.when(lo < hi, some)).alias(f"b{a}"))
    return out


def assign_lpt(tiles: DataFrame, bins: int) -> DataFrame:
    """(tile_id, bin, load): longest first, each to the least loaded bin (ties: lower bin). Tiles are plan-sized, so the driver's heap."""
    if bins < 1:
        raise ValueError("there must be a bin")
    heap = [(0.0, k) for k in range(bins)]
    rows = []
    for r in tiles.select("tile_id", "cost").orderBy(C("cost").desc(), "tile_id").toLocalIterator():
        load, k = heapq.heappop(heap)
        rows.append((r["tile_id"], k, load + r["cost"]))
        heapq.heappush(heap, (load + r["cost"], k))
    return tiles.sparkSession.createDataFrame(rows, "tile_id long, bin int, load double")


def remaining(tiles: DataFrame, written: DataFrame) -> DataFrame:
    """Tiles still to do after a restart."""
    return tiles.join(written, "tile_id", "left_anti")


def finalize(results: DataFrame, points: DataFrame, allow_partial: bool) -> DataFrame:
    """Results of all points; with ``allow_partial`` those not written yet as NOT_SEARCHED (-3), else that is an error."""
    absent = points.join(results, "point_id", "left_anti")
    if not allow_partial:
        n = absent.count()
        if n:
            raise ValueError(f"{n} points have no result")
        return results
    fill = absent.select("point_id", F.lit(-3).alias("status"), *[F.lit(0.0).alias(c) for c in "uvw"])
    return results.select("point_id", "status", *"uvw").unionByName(fill)
