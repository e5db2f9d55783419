"""The correlation plan: points are dealt to tiles, tiles are joined with the bricks they need, tiles are solved.

A tile's task gets its points and the bricks of both images that its boxes cover (an equi-join on brick
places), so memory is bounded by the tile size, the halo and the seeds' spread, not by the volumes. There is
one shuffle of points and one of bricks, both by tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.functions.kernels import Search, Volume, gaussian, solve
from corrvox.operators import seeding, tiling
from corrvox.operators.kdtree import kd_tiles
from corrvox.operators.knn import knn
from corrvox.operators.tables import Shelves, new_folder, shuffles
from corrvox.sources.volumes import assemble, brick_rows

C = F.col
OUT = "point_id long, x double, y double, z double, status int, objmin double, u double, v double, w double, params array<double>, n_iter int, seed_u double, seed_v double, seed_w double"
KEY = ["tx", "ty", "tz", "part"]


def _boxes(tiles: DataFrame, prefix: str, shape: tuple[int, int, int], brick: int, bricks: DataFrame) -> DataFrame:
    cover = tiling.bricks_of(tiles, brick, prefix, shape)
    lo_hi = [C(f"{prefix}_{a}_{e}").cast("long").alias(f"{e}_{a}") for a in "xyz" for e in ("lo", "hi")]
    return cover.select(*KEY, "bx", "by", "bz", *lo_hi).join(bricks, ["bx", "by", "bz"]).withColumn("image", F.lit(prefix))


def reach(offsets: np.ndarray, search: Search, sigma: float = 0.0) -> float:
    """How far from its points a tile reads: the sample set, the search, the interpolation and the blur."""
    blur = math.ceil(4 * sigma) if sigma > 0 else 0
    return float(np.sqrt((offsets**2).sum(1)).max()) + search.disp_max + 2.0 + blur


def reach_box(points: DataFrame, far: float) -> tuple[tuple, tuple] | None:
    """[lo, hi) (x, y, z) that tiles of ``points`` (with seeds) can read in either image; one row is read, None without points.

    A tile's deformed box is moved by a middle seed and grown by the largest distance from it, so it ends within
    twice the least seed less the greatest, and the other way round.
    """
    r = points.agg(*[f(n).alias(f"{n}{e}") for n in ("x", "y", "z", "su", "sv", "sw") for e, f in ((0, F.min), (1, F.max))]).first()
    if r["x0"] is None:
        return None
    lo = [r[f"{a}0"] + min(0.0, 2 * r[f"{s}0"] - r[f"{s}1"]) - far - 3 for a, s in zip("xyz", ("su", "sv", "sw"), strict=True)]
    hi = [r[f"{a}1"] + max(0.0, 2 * r[f"{s}1"] - r[f"{s}0"]) + far + 3 for a, s in zip("xyz", ("su", "sv", "sw"), strict=True)]
    return tuple(map(math.floor, lo)), tuple(math.ceil(v) + 1 for v in hi)


def correlate(points: DataFrame, ref: DataFrame, deformed: DataFrame, shape: tuple[int, int, int], offsets: np.ndarray, search: Search, tile: float = 64.0, brick: int = 32, sigma: float = 0.0, most: int | None = None, cut=None) -> DataFrame:
    """A result (OUT) for each point (point_id, x, y, z, and seeds su, sv, sw).

    ``shape`` is (x, y, z). ``sigma``: a Gaussian applied to both images first. With ``most`` (and ``cut``) tiles are the leaves
    of a k-d tree of at most so many points and ``tile`` long, so a dense cloud is cut over as many tasks as it needs.
    A tile of many points is solved in parts; copies of a point with one seed are solved once in a part.
    """
    dealt = tiling.tile_of(points, tile) if most is None else cut(kd_tiles(points, most, tile / 16, tile, cut))
    dealt = tiling.parted(dealt, KEY[:3])
    tiles = tiling.plan_dealt(dealt, reach(offsets, search, sigma), float(len(offsets)), tuple(KEY))
    own = dealt.select(*[C(k).alias(k) for k in KEY], "point_id", "x", "y", "z", "su", "sv", "sw")
    cols = ["bx", "by", "bz", "nx", "ny", "nz", "dtype", "data"]
    need = _boxes(tiles, "ref", shape, brick, ref.select(*cols)).unionByName(_boxes(tiles, "def", shape, brick, deformed.select(*cols)))

    def image(rows: pd.DataFrame) -> Volume:
        if not len(rows):
            return Volume(np.full((1, 1, 1), np.nan))
        r = rows.iloc[0]
        lo = tuple(int(max(r[f"lo_{a}"], 0)) for a in "xyz")
        hi = tuple(int(min(r[f"hi_{a}"], n)) for a, n in zip("xyz", shape, strict=True))
        data = assemble(rows[cols].itertuples(index=False, name=None), lo, hi, brick)
        return Volume(gaussian(data, sigma), lo)

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        centres, seeds = p[["x", "y", "z"]].to_numpy(float), p[["su", "sv", "sw"]].to_numpy(float)
        r = solve(image(b[b.image == "ref"]), image(b[b.image == "def"]), centres, seeds, offsets, search)
        out = p[["point_id", "x", "y", "z"]].copy()
        out["status"], out["objmin"] = r["status"].astype(int), r["objmin"]
        for k, c in enumerate("uvw"):
            out[c] = r["params"][:, k]
        out["params"], out["n_iter"] = list(r["params"]), r["n_iter"].astype(int)
        for k, c in enumerate("uvw"):
            out[f"seed_{c}"] = seeds[:, k]
        return out

    # A tile is little data and much work: with a stated number of partitions they are not coalesced by their bytes.
    own, need = (df.repartition(shuffles(df.sparkSession), *KEY) for df in (own, need))
    return own.groupBy(*KEY).cogroup(need.groupBy(*KEY)).applyInPandas(run, OUT)


def rigid_seeds(points: DataFrame, rigid=(0.0, 0.0, 0.0)) -> DataFrame:
    return points.select("point_id", "x", "y", "z", *[F.lit(float(r)).alias(f"s{c}") for c, r in zip("uvw", rigid, strict=True)])


def _solver(folder: str, **plan) -> Callable[[DataFrame, int], DataFrame]:
    def solve(seeds: DataFrame, shell: int) -> DataFrame:
        kept = Shelves(seeds.sparkSession, f"{folder}/solved", "shell", f"{OUT}, shell int")
        kept.put(correlate(seeds, **plan).withColumn("shell", F.lit(shell)))
        return kept.get(shell).drop("shell")

    return solve


def wavefront(points: DataFrame, start, width: float, k: int, cell: float, cut, rigid=(0.0, 0.0, 0.0), solve=None, folder: str | None = None, **plan) -> DataFrame:
    """Solve shell by shell, each point from the mean of its GOOD neighbours in earlier shells.

    Shells depend on each other, so this is a loop on the driver. What a later shell needs is sent ahead: when a shell is
    solved, its GOOD displacements go along the edges that leave it to the shelf of the shell they lead to. A shell reads its
    points, its shelf and its edges, so every row is read once, however many shells there are. ``solve`` gets a shell's seeds
    and number and returns its results without lineage; left out, each shell is correlated and kept below ``folder``.
    """
    spark = points.sparkSession
    folder = folder or new_folder(spark)
    solve = solve or _solver(folder, **plan)
    shells = cut(seeding.wavefront_shells(points, start, width).select("point_id", "x", "y", "z", "shell"))
    own = Shelves(spark, f"{folder}/points", "shell", "point_id long, x double, y double, z double, shell int")
    edges = Shelves(spark, f"{folder}/edges", "source", "neighbour_id long, point_id long, shell int, source int")
    sent = Shelves(spark, f"{folder}/sent", "shell", "point_id long, u double, v double, w double, shell int")
    own.put(shells)
    of = lambda name, number: shells.select(C("point_id").alias(name), C("shell").alias(number))
    near = knn(points, points, k, cell).select("point_id", "neighbour_id")
    edges.put(near.join(of("point_id", "shell"), "point_id").join(of("neighbour_id", "source"), "neighbour_id").where("source < shell"))
    last = shells.agg(F.max("shell")).first()[0]
    done: list[DataFrame] = []
    for s in range(-1 if last is None else last + 1):
        mean = sent.get(s).groupBy("point_id").agg(*[F.avg(c).alias(f"m{c}") for c in "uvw"])
        seed = [F.coalesce(f"m{c}", F.lit(float(r))).alias(f"s{c}") for c, r in zip("uvw", rigid, strict=True)]
        done.append(solve(own.get(s).join(mean, "point_id", "left").select("point_id", "x", "y", "z", *seed), s))
        if s < last:
            good = done[-1].where("status = 0").select(C("point_id").alias("neighbour_id"), *"uvw")
            sent.put(edges.get(s).join(good, "neighbour_id").select("point_id", *"uvw", "shell"))
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], OUT)


def coarse(points: DataFrame, stride: int, spacing: float, start, width: float, k: int, cell: float, cut, rigid=(0.0, 0.0, 0.0), **plan) -> DataFrame:
    """A wavefront over every stride-th point gives a seed field; all points are then solved in one job."""
    few = seeding.coarse_subset(points, stride, spacing)
    field = wavefront(few, start, width, k, cell, cut, rigid, **plan)
    seeds = seeding.interpolate_seeds(points, field, 8, cell, rigid)
    return correlate(points.join(seeds, "point_id"), **plan)


def uncertainty(results: DataFrame, repeats: list[np.ndarray], **plan) -> DataFrame:
    """point_id, sd_u, sd_v, sd_w: spread over the result and solves with other sample sets from the same seed; null with fewer than two GOOD."""
    start = results.select("point_id", "x", "y", "z", *[C(f"seed_{c}").alias(f"s{c}") for c in "uvw"])
    stack = results.select("point_id", "status", *"uvw")
    for o in repeats:
        stack = stack.unionByName(correlate(start, offsets=o, **plan).select("point_id", "status", *"uvw"))
    good = C("status") == 0
    return stack.groupBy("point_id").agg(*[F.when(F.count(F.when(good, 1)) > 1, F.stddev_samp(F.when(good, C(c)))).alias(f"sd_{c}") for c in "uvw"])


# --- synthetic images ---------------------------------------------------------------------------------------


def wave_values(waves: np.ndarray, x: np.ndarray) -> np.ndarray:
    """100 + 10 sum cos(k.x + phase) at places (..., 3); ``waves``: rows of kx, ky, kz, phase."""
    return 100 + 10 * np.cos(x @ waves[:, :3].T + waves[:, 3]).sum(-1)


def wave_bricks(spark: SparkSession, waves: np.ndarray, shape, brick: int, back=None) -> DataFrame:
    """Bricks of a plane-wave volume; ``back`` maps a voxel of the deformed image to where it came from."""
    nx, ny, nz = shape

    def read(lo, hi):
        z, y, x = np.meshgrid(*[np.arange(a, b, dtype=float) for a, b in zip(lo[::-1], hi[::-1], strict=True)], indexing="ij")
        p = np.stack([x, y, z], -1)
        return wave_values(waves, p if back is None else back(p))

    def run(batches):
        for b in batches:
            rows = [r for k in b["id"] for r in brick_rows(read, shape, brick, int(k) // -(-ny // brick), int(k) % -(-ny // brick))]
            yield pd.DataFrame(rows, columns=["bx", "by", "bz", "nx", "ny", "nz", "dtype", "data"])

    from corrvox.sources.volumes import SCHEMA

    n = -(-nz // brick) * -(-ny // brick)
    return spark.range(0, n, 1, min(n, 64)).mapInPandas(run, SCHEMA)


def speckle_bricks(spark: SparkSession, shape, brick: int, feature: float, seed: int) -> DataFrame:
    """Random speckle: each voxel's noise follows from (seed, brick), so the data don't depend on partitions."""
    sigma = feature / 2
    r = int(np.ceil(4 * sigma))

    def noise(bx, by, bz):
        return np.random.default_rng([seed, bx & 0xFFFF, by & 0xFFFF, bz & 0xFFFF]).standard_normal((brick,) * 3)

    def read(lo, hi):
        a, b = [v - r for v in lo], [v + r for v in hi]
        wide = np.zeros((b[2] - a[2], b[1] - a[1], b[0] - a[0]))
        for bz in range(a[2] // brick, (b[2] - 1) // brick + 1):
            for by in range(a[1] // brick, (b[1] - 1) // brick + 1):
                for bx in range(a[0] // brick, (b[0] - 1) // brick + 1):
                    n, src, dst = noise(bx, by, bz), [], []
                    for k, v in ((2, bz), (1, by), (0, bx)):
                        s, e = max(a[k], v * brick), min(b[k], (v + 1) * brick)
                        src.append(slice(s - v * brick, e - v * brick))
                        dst.append(slice(s - a[k], e - a[k]))
                    wide[tuple(dst)] = n[tuple(src)]
        out = gaussian(wide, sigma)[r : r + hi[2] - lo[2], r : r + hi[1] - lo[1], r : r + hi[0] - lo[0]]
        return np.clip(np.rint(32768 + out * 8000 * (2 * sigma * np.sqrt(np.pi)) ** 1.5), 0, 65535).astype(np.uint16)

    ny, nz = shape[1], shape[2]
    per = -(-ny // brick)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r_ for k in b["id"] for r_ in brick_rows(read, shape, brick, int(k) // per, int(k) % per)], columns=["bx", "by", "bz", "nx", "ny", "nz", "dtype", "data"])

    from corrvox.sources.volumes import SCHEMA

    n = -(-nz // brick) * per
    return spark.range(0, n, 1, min(n, 64)).mapInPandas(run, SCHEMA)
