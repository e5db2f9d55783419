"""Synthetic cases and the lattices of points that they and the studies are solved on."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.config import RunConfig
from corrvox.functions.fields_numpy import Field, origin_of
from corrvox.operators.tiling import tile_of
from corrvox.plans.correlate import wave_bricks
from corrvox.sources.volumes import assemble

C = F.col
AXES = ("x", "y", "z")


def grid(spark: SparkSession, low: tuple, high: tuple, spacing: float) -> DataFrame:
    """(id, x, y, z): a lattice from ``low`` up to ``high`` (included), x slowest."""
    n = [int(math.floor((b - a + 1e-9) / spacing)) + 1 if b + 1e-9 >= a else 0 for a, b in zip(low, high, strict=True)]
    i = C("id")
    step = (n[1] * n[2], n[2], 1)
    return spark.range(n[0] * n[1] * n[2]).select(i, *[(F.lit(float(low[k])) + F.floor(i / step[k]) % n[k] * float(spacing)).alias(a) for k, a in enumerate(AXES)])


def lattices(boxes: DataFrame) -> DataFrame:
    """A lattice for each row of ``boxes`` (lo_x to hi_z, both ends included, spacing): its other columns and id, x, y, z, x slowest."""
    n = {f"_n{a}": F.greatest(F.floor((C(f"hi_{a}") - C(f"lo_{a}") + 1e-9) / C("spacing")) + 1, F.lit(0)).cast("long") for a in AXES}
    other = [c for c in boxes.columns if c not in {"spacing", *[f"{e}_{a}" for e in ("lo", "hi") for a in AXES]}]
    many = C("_nx") * C("_ny") * C("_nz")
    rows = boxes.withColumns(n).where(many > 0).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    step = {"x": C("_ny") * C("_nz"), "y": C("_nz"), "z": F.lit(1)}
    return rows.select(*other, "id", *[(C(f"lo_{a}") + F.floor(C("id") / step[a]) % C(f"_n{a}") * C("spacing")).alias(a) for a in AXES])


def centre_first(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Lattices by ``key`` with point_id from 1: the point nearest its box's middle changes places with the first, so that a
    wavefront from the first point has compact shells. A row for each box is joined back."""
    mid = boxes.select(key, *[((C(f"lo_{a}") + C(f"hi_{a}")) / 2).alias(f"_m{a}") for a in AXES])
    d = [C(a) - C(f"_m{a}") for a in AXES]
    near = points.join(mid, key).groupBy(key).agg(F.min_by("id", F.struct(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), C("id"))).alias("centre"))
    place = F.when(C("id") == C("centre"), 0).when(C("id") == 0, C("centre")).otherwise(C("id"))
    return points.join(near, key).select(key, (place + 1).cast("long").alias("point_id"), *AXES)


def grid_points(spark: SparkSession, low: tuple, high: tuple, spacing: float) -> DataFrame:
    """(point_id, x, y, z) of a lattice over a box; the point nearest the middle changes places with the first, so that
    a wavefront from the first point has compact shells."""
    g = grid(spark, low, high, spacing)
    middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    d2 = sum(((C(a) - m) * (C(a) - m) for a, m in zip(AXES[1:], middle[1:], strict=True)), (C("x") - middle[0]) * (C("x") - middle[0]))
    one = g.agg(F.min_by("id", F.struct(F.sqrt(d2), C("id"))).alias("centre"))  # one row
    g = g.join(F.broadcast(one))
    place = F.when(C("id") == C("centre"), 0).when(C("id") == 0, C("centre")).otherwise(C("id"))
    return g.select((place + 1).cast("long").alias("point_id"), *AXES)


def inner_grid(spark: SparkSession, shape: tuple[int, int, int], spacing: float, margin: float) -> DataFrame:
    """(point_id, x, y, z): a lattice that begins ``margin`` from the lower faces and ends no nearer to the upper ones."""
    return grid(spark, (margin,) * 3, tuple(n - 1 - margin for n in shape), spacing).select((C("id") + 1).cast("long").alias("point_id"), *AXES)


def case_points(spark: SparkSession, shape: tuple[int, int, int], spacing: float, margin: float) -> DataFrame:
    """(x, y, z): a lattice through the middle of the volume, no nearer than ``margin`` to a face."""
    half = [(n - 1) / 2 for n in shape]
    many = [max(0, math.floor((h - margin + 1e-9) / spacing)) if h >= margin else -1 for h in half]
    if min(many) < 0:
        return spark.createDataFrame([], "x double, y double, z double")
    low, high = ([h + s * m * spacing for h, m in zip(half, many, strict=True)] for s in (-1, 1))
    return grid(spark, tuple(low), tuple(high), spacing).select(*AXES)


def centred_grid(spark: SparkSession, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """(x, y, z): a lattice whose remainder is shared by both faces."""
    low = [math.fmod(n - 1, spacing) / 2 for n in shape]
    return grid(spark, tuple(low), tuple(n - 1 for n in shape), spacing).select(*AXES)


def in_mask(points: DataFrame, mask: DataFrame, shape: tuple[int, int, int], brick: int, erode: float = 0.0, move: tuple = (0.0, 0.0, 0.0), tile: float = 64.0) -> DataFrame:
    """The points whose nearest voxel (after ``move``) is in the mask and at least ``erode`` from any voxel that isn't.

    ``mask``: bricks, 0 is outside; the volume's border counts as outside. Points are dealt to tiles, a tile gets the
    bricks that its voxels and the margin cover.
    """
    m = int(math.ceil(erode)) + 1 if erode > 0 else 0
    cols = points.columns
    p = points.select("*", *[F.rint(C(a) + float(d)).cast("int").alias(f"_{a}") for a, d in zip(AXES, move, strict=True)])
    inside = [C(f"_{a}").between(0, n - 1) for a, n in zip(AXES, shape, strict=True)]
    p = tile_of(p.where(inside[0] & inside[1] & inside[2]), tile)
    key = ["tx", "ty", "tz"]
    boxes = p.groupBy(*key).agg(*[f(f"_{a}").alias(f"{e}_{a}") for a in AXES for e, f in (("lo", F.min), ("hi", F.max))])
    for a, n in zip(AXES, shape, strict=True):
        some = F.sequence(F.floor(F.greatest(C(f"lo_{a}") - m, F.lit(0)) / brick).cast("int"), F.floor(F.least(C(f"hi_{a}") + m, F.lit(n - 1)) / brick).cast("int"))
        boxes = boxes.withColumn(f"b{a}", F.explode(some))
    names = ["bx", "by", "bz", "nx", "ny", "nz", "dtype", "data"]
    need = boxes.join(mask.select(*names), ["bx", "by", "bz"]).select(*names, *[C(k).alias(f"of_{k}") for k in key])
    reach = np.arange(-m, m + 1)
    ball = np.stack(np.meshgrid(reach, reach, reach, indexing="ij"), -1).reshape(-1, 3)
    ball = ball[(ball**2).sum(1) < erode**2] if erode > 0 else np.zeros((1, 3), int)

    def keep(left, right):
        if not len(left) or not len(right):
            return left[cols].iloc[:0]
        at = left[[f"_{a}" for a in AXES]].to_numpy()
        lo = at.min(0) - m
        hi = at.max(0) + m + 1
        a = assemble(right[names].itertuples(index=False, name=None), tuple(lo), tuple(hi), brick)
        solid = np.nan_to_num(a, nan=0.0) != 0  # what no brick holds is outside
        ok = np.ones(len(at), bool)
        for o in ball:
            x, y, z = (at - lo + o).T
            ok &= solid[z, y, x]
        return left.loc[ok, cols]

    return p.groupBy(*key).cogroup(need.groupBy(*[f"of_{k}" for k in key])).applyInPandas(keep, points.schema)


@dataclass(frozen=True)
class NamedCase:
    name: str
    dataset: str
    reference: str
    deformed: str
    size: float
    group: str
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    truth: tuple[float, float, float] | None = None
    strain_y: float | None = None


# Fixed values of the public data sets: case, data set, scans, size of the sample sets, group, offset of the second scan in
# voxels, true displacement, true strain along y (- where it isn't known).
NAMED_CASES = """
dvc1_repeat1_24      dvc1        XCT1_Scan0_Reference  XCT1_Scan1_Repeat1    24  repeat      0    0  0   - - -     -
dvc1_repeat2_24      dvc1        XCT1_Scan0_Reference  XCT1_Scan2_Repeat2    24  repeat      0    0  0   - - -     -
dvc1_repeat1_32      dvc1        XCT1_Scan0_Reference  XCT1_Scan1_Repeat1    32  repeat      0    0  0   - - -     -
dvc1_repeat2_32      dvc1        XCT1_Scan0_Reference  XCT1_Scan2_Repeat2    32  repeat      0    0  0   - - -     -
dvc1_repeat1_48      dvc1        XCT1_Scan0_Reference  XCT1_Scan1_Repeat1    48  repeat      0    0  0   - - -     -
dvc1_repeat2_48      dvc1        XCT1_Scan0_Reference  XCT1_Scan2_Repeat2    48  repeat      0    0  0   - - -     -
dvc1_axial1_32       dvc1        XCT1_Scan0_Reference  XCT1_Scan3_Axial1     32  axial       0    0  58  - - -     -
dvc1_axial2_32       dvc1        XCT1_Scan0_Reference  XCT1_Scan4_Axial2     32  axial       0    0  58  - - -     -
dvc1_radial1_32      dvc1        XCT1_Scan0_Reference  XCT1_Scan5_Radial1    32  radial      -57  0  0   - - -     -
dvc1_radial2_32      dvc1        XCT1_Scan0_Reference  XCT1_Scan6_Radial2    32  radial      -58  0  0   - - -     -
translation_0.0      translation vol_translation_1000  vol_translation_1001  40  translation 0    0  0   0 0 0     -
translation_0.1      translation vol_translation_1000  vol_translation_1002  40  translation 0    0  0   0 0.1 0   -
translation_0.2      translation vol_translation_1000  vol_translation_1003  40  translation 0    0  0   0 0.2 0   -
translation_0.3      translation vol_translation_1000  vol_translation_1004  40  translation 0    0  0   0 0.3 0   -
translation_0.4      translation vol_translation_1000  vol_translation_1005  40  translation 0    0  0   0 0.4 0   -
translation_0.5      translation vol_translation_1000  vol_translation_1006  40  translation 0    0  0   0 0.5 0   -
translation_0.6      translation vol_translation_1000  vol_translation_1007  40  translation 0    0  0   0 0.6 0   -
translation_0.7      translation vol_translation_1000  vol_translation_1008  40  translation 0    0  0   0 0.7 0   -
translation_0.8      translation vol_translation_1000  vol_translation_1009  40  translation 0    0  0   0 0.8 0   -
translation_0.9      translation vol_translation_1000  vol_translation_1010  40  translation 0    0  0   0 0.9 0   -
translation_1.0      translation vol_translation_1000  vol_translation_1011  40  translation 0    0  0   0 1 0     -
stretch_1            stretch     vol_stretch_1001      vol_stretch_1002      40  stretch     0    0  0   - - -     0.05
stretch_2            stretch     vol_stretch_1001      vol_stretch_1003      40  stretch     0    0  0   - - -     0.1
stretch_3            stretch     vol_stretch_1001      vol_stretch_1004      40  stretch     0    0  0   - - -     0.15
stretch_4            stretch     vol_stretch_1001      vol_stretch_1005      40  stretch     0    0  0   - - -     0.2
stretch_5            stretch     vol_stretch_1001      vol_stretch_1006      40  stretch     0    0  0   - - -     0.25
stretch_6            stretch     vol_stretch_1001      vol_stretch_1007      40  stretch     0    0  0   - - -     0.3
"""


def named_cases() -> list[NamedCase]:
    """The 27 public cases: repeats and moves of a foam scan, translated and stretched beads."""
    out = []
    for line in NAMED_CASES.strip().splitlines():
        name, dataset, reference, deformed, size, group, *numbers = line.split()
        offset, truth, strain = numbers[:3], numbers[3:6], numbers[6]
        known = None if truth[0] == "-" else tuple(map(float, truth))
        out.append(NamedCase(name, dataset, reference, deformed, float(size), group, tuple(map(float, offset)), known, None if strain == "-" else float(strain)))
    return out


def make_case(spark: SparkSession, out: str, shape: tuple[int, int, int], field: Field, settings: RunConfig, spacing: float = 16.0, noise: float = 0.0, seed: int = 0, brick: int = 32) -> RunConfig:
    """Write a synthetic case below ``out``: bricks of both images, the points, their true displacements, the settings.

    Images are plane waves (their values are known everywhere, so nothing is resampled); ``noise`` is the standard
    deviation of Gaussian noise as a share of the waves' amplitude, drawn for each brick from (seed, image, place).
    Returns ``settings`` with the case's paths. An existing case is refused.
    """
    probe = np.stack(np.meshgrid(*[np.linspace(0, n - 1, 17) for n in shape], indexing="ij"), -1).reshape(-1, 3)
    most = float(np.sqrt((field.at(probe) ** 2).sum(1)).max())
    if most + 1 > settings.search.disp_max:
        raise ValueError(f"the field reaches {most:.2f} voxels; raise search.disp_max above {most + 1:.1f}")
    margin = float(np.sqrt((settings.offsets() ** 2).sum(1)).max()) + most + 3.0
    points = case_points(spark, shape, spacing, margin).orderBy("z", "y", "x").toPandas()  # a lattice that fits a test image
    if not len(points):
        raise ValueError(f"no points fit: volume {shape} is too small for margin {margin:.1f}")
    xyz = points[list(AXES)].to_numpy(float)
    rng = np.random.default_rng(seed)
    waves = np.column_stack([rng.uniform(0.1, 0.5, (24, 3)) * rng.choice([-1, 1], (24, 3)), rng.uniform(0, 2 * np.pi, 24)])
    for k, (name, back) in enumerate((("ref", None), ("def", lambda p: origin_of(field, p)))):
        noisy(wave_bricks(spark, waves, shape, brick, back), 10 * noise, seed, k).write.mode("error").parquet(f"{out}/{name}")
    u = field.at(xyz)
    rows = [(i + 1, *map(float, p), *map(float, d)) for i, (p, d) in enumerate(zip(xyz, u, strict=True))]
    truth = spark.createDataFrame(rows, "point_id long, x double, y double, z double, u double, v double, w double")
    truth.write.mode("error").parquet(f"{out}/truth")
    truth.select(F.concat_ws("\t", *[C(c).cast("string") for c in ("point_id", *AXES)]).alias("line")).coalesce(1).write.mode("error").text(f"{out}/points")
    tree = asdict(settings)
    tree["volumes"] |= {"reference": f"{out}/ref", "deformed": f"{out}/def", "raw_shape_xyz": list(shape)}
    tree |= {"points": f"{out}/points", "output": f"{out}/results"}
    spark.createDataFrame([(json.dumps(tree),)], "value string").coalesce(1).write.mode("error").text(f"{out}/config")
    from corrvox.config import build

    return build(RunConfig, json.loads(json.dumps(tree)))


def noisy(bricks: DataFrame, sigma: float, seed: int, image: int) -> DataFrame:
    """Bricks with Gaussian noise that follows from (seed, image, place) alone."""
    if not sigma:
        return bricks

    def add(batches):
        for b in batches:
            data = []
            for r in b.itertuples(index=False):
                a = np.frombuffer(r.data, r.dtype)
                data.append((a + sigma * np.random.default_rng([seed, image, r.bx, r.by, r.bz]).standard_normal(len(a))).astype(r.dtype).tobytes())
            yield b.assign(data=data)

    return bricks.mapInPandas(add, bricks.schema)
