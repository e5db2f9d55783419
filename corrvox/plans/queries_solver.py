"""The solver on plane-wave volumes with known displacements: the twins are the known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corrvox.functions.kernels import Search, cube_offsets, sphere_offsets
from corrvox.operators.tables import cut
from corrvox.plans import correlate as c
from corrvox.plans.fixtures import rd, table
from corrvox.plans.registry import query
from corrvox.sources.volumes import in_box, voxel_rows

C = F.col
SHAPE, BRICK, TILE = (40, 40, 40), 16, 12.0
SHIFT = (1.3, -0.7, 0.4)
_LATTICE = "l AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, 12 + 4.0::DOUBLE * (s_suppkey % 5) AS x, 12 + 4.0::DOUBLE * (s_suppkey // 5 % 5) AS y, 12 + 4.0::DOUBLE * (s_suppkey // 25 % 5) AS z FROM supplier)"


def _known(u, v, w, status=0):
    return f"WITH {_LATTICE} SELECT point_id, x, y, z, CAST({status} AS INT) AS status, {u}::DOUBLE AS u, {v}::DOUBLE AS v, {w}::DOUBLE AS w FROM l"


def waves(spark, d) -> np.ndarray:
    """24 waves (kx, ky, kz, phase) from ``part``; components 0.05 to 0.15 of either sign. A table of fixed size."""
    k = C("p_partkey")
    part = lambda m, n: ((k * m) % 41 / 400 + 0.05) * F.when((k * n) % 2 == 0, 1.0).otherwise(-1.0)
    rows = table(spark, d, "part").where(k < 24).select("p_partkey", part(37, 1).alias("kx"), part(29, 3).alias("ky"), part(23, 1).alias("kz"), ((k * 17) % 63 / 10).alias("phase"))
    rows = rows.withColumn("ky", C("ky") * F.when(k % 4 < 2, 1.0).otherwise(-1.0)).withColumn("kz", C("kz") * F.when(k % 8 < 4, 1.0).otherwise(-1.0))
    return np.array([tuple(r)[1:] for r in rows.orderBy("p_partkey").collect()], float)


def lattice(spark, d):
    """A point for each supplier, on the 125 places of a lattice."""
    i = C("s_suppkey").cast("long")
    return table(spark, d, "supplier").select(i.alias("point_id"), (12 + 4.0 * (i % 5)).alias("x"), (12 + 4.0 * (F.floor(i / 5) % 5)).alias("y"), (12 + 4.0 * (F.floor(i / 25) % 5)).alias("z"))


def images(spark, d, back):
    w = waves(spark, d)
    return {"ref": c.wave_bricks(spark, w, SHAPE, BRICK), "deformed": c.wave_bricks(spark, w, SHAPE, BRICK, back), "shape": SHAPE, "brick": BRICK, "tile": TILE}


def shifted(p):
    return p - np.array(SHIFT)


def _answer(r, digits=3):
    return r.select("point_id", "x", "y", "z", "status", *[rd(C(n), digits).alias(n) for n in "uvw"])


#: Stop only where nothing changes, so that rows can be compared at 3 digits.
TIGHT = {"disp_max": 3.0, "obj_tol": 1e-14, "disp_tol": 1e-7}


def _solve(spark, d, search=None, offsets=None, back=shifted, seeds=(0.0, 0.0, 0.0), **kw):
    return c.correlate(c.rigid_seeds(lattice(spark, d), seeds), offsets=cube_offsets(512, 12.0) if offsets is None else offsets, search=search or Search(**TIGHT), **images(spark, d, back), **kw)


@query("solve_rigid", _known(*SHIFT))
def solve_rigid(spark, d):
    return _answer(_solve(spark, d))


def _kind(kind):
    @query(f"solve_{kind}", _known(*SHIFT))
    def run(spark, d):
        return _answer(_solve(spark, d, Search(**TIGHT, objective=kind)))


for _k in ("sad", "ssd", "zssd", "nssd"):
    _kind(_k)


@query("solve_trilinear", f"WITH {_LATTICE} SELECT point_id, CAST(0 AS INT) AS status, true AS near FROM l")
def solve_trilinear(spark, d):
    r = _solve(spark, d, Search(disp_max=3.0, interpolation="trilinear"))
    return r.select("point_id", "status", (F.greatest(*[F.abs(C(n) - s) for n, s in zip("uvw", SHIFT, strict=True)]) < 0.1).alias("near"))


@query("solve_nearest", f"WITH {_LATTICE} SELECT point_id, CAST(-5 AS INT) AS status FROM l")
def solve_nearest(spark, d):
    """Nearest-voxel samples have no gradient, so nothing can be solved: SINGULAR."""
    return _solve(spark, d, Search(disp_max=3.0, interpolation="nearest")).select("point_id", "status")


ANGLES = (0.02, -0.015, 0.01)


def _turned(p):
    from corrvox.functions.kernels import deformation

    m = np.linalg.inv(deformation(np.array([[0, 0, 0, *ANGLES]], float))[0])
    return (p - 20 - np.array(SHIFT)) @ m.T + 20


@query("solve_6dof", f"WITH {_LATTICE} SELECT point_id, CAST(0 AS INT) AS status, 0.02::DOUBLE AS phi, -0.015::DOUBLE AS the, 0.01::DOUBLE AS psi FROM l")
def solve_6dof(spark, d):
    r = _solve(spark, d, Search(dof=6, **TIGHT), back=_turned, offsets=sphere_offsets(600, 13.0))
    return r.select("point_id", "status", *[rd(F.get("params", F.lit(3 + k)), 3).alias(n) for k, n in enumerate(("phi", "the", "psi"))])


STRETCH = (0.02, -0.01, 0.015)


def _stretched(p):
    return (p - 20 - np.array(SHIFT)) / (1 + np.array(STRETCH)) + 20


@query("solve_12dof", f"WITH {_LATTICE} SELECT point_id, CAST(0 AS INT) AS status, 0.02::DOUBLE AS exx, -0.01::DOUBLE AS eyy, 0.015::DOUBLE AS ezz, 0.0::DOUBLE AS exy, true AS near FROM l")
def solve_12dof(spark, d):
    r = _solve(spark, d, Search(dof=12, **TIGHT), back=_stretched, offsets=sphere_offsets(1000, 14.0))
    truth = [F.lit(s) + (C(a) - 20) * e for s, a, e in zip(SHIFT, "xyz", STRETCH, strict=True)]
    near = F.greatest(*[F.abs(C(n) - t) for n, t in zip("uvw", truth, strict=True)]) < 0.002
    return r.select("point_id", "status", *[rd(F.get("params", F.lit(6 + k)), 3).alias(n) for k, n in enumerate(("exx", "eyy", "ezz", "exy"))], near.alias("near"))


@query("solve_range_fail", f"WITH {_LATTICE} SELECT point_id, CAST(-1 AS INT) AS status FROM l")
def solve_range_fail(spark, d):
    """Subvolumes that leave the image: RANGE_FAIL."""
    return _solve(spark, d, offsets=cube_offsets(125, 60.0)).select("point_id", "status")


@query("solve_thresh_fail", f"WITH {_LATTICE} SELECT point_id, CAST(-4 AS INT) AS status FROM l")
def solve_thresh_fail(spark, d):
    return _solve(spark, d, Search(disp_max=3.0, threshold=(1e5, 2e5, 0.5))).select("point_id", "status")


@query("solve_convg_fail", f"WITH {_LATTICE} SELECT point_id, CAST(-2 AS INT) AS status, CAST(1 AS INT) AS n_iter FROM l")
def solve_convg_fail(spark, d):
    return _solve(spark, d, Search(disp_max=3.0, max_iterations=1)).select("point_id", "status", "n_iter")


@query("solve_basin", _known(2.6, -1.8, 1.2))
def solve_basin(spark, d):
    return _answer(_solve(spark, d, Search(**TIGHT, basin_radius=1.0), back=lambda p: p - np.array([2.6, -1.8, 1.2])))


@query("solve_prefiltered", _known(*SHIFT))
def solve_prefiltered(spark, d):
    return _answer(_solve(spark, d, sigma=0.7))


def _plan(spark, d):
    return {"offsets": cube_offsets(512, 12.0), "search": Search(**TIGHT), **images(spark, d, shifted)}


@query("solve_wavefront", _known(*SHIFT))
def solve_wavefront(spark, d):
    return _answer(c.wavefront(lattice(spark, d), (20.0, 20.0, 20.0), 6.0, 6, 8.0, cut, **_plan(spark, d)))


@query("solve_coarse", _known(*SHIFT))
def solve_coarse(spark, d):
    return _answer(c.coarse(lattice(spark, d), 2, 4.0, (20.0, 20.0, 20.0), 10.0, 6, 16.0, cut, **_plan(spark, d)))


@query("uncertainty", f"WITH {_LATTICE} SELECT point_id, 0.0::DOUBLE AS sd_u, 0.0::DOUBLE AS sd_v, 0.0::DOUBLE AS sd_w FROM l")
def uncertainty(spark, d):
    """Images without noise: other sample sets find the same displacement to 3 digits."""
    plan = _plan(spark, d) | {"offsets": sphere_offsets(400, 12.0, 0)}
    first = cut(c.correlate(c.rigid_seeds(lattice(spark, d)), **plan))
    plan.pop("offsets")
    u = c.uncertainty(first, [sphere_offsets(400, 12.0, s) for s in (1, 2, 3)], **plan)
    return u.select("point_id", *[rd(C(f"sd_{n}"), 3).alias(f"sd_{n}") for n in "uvw"])


_WAVES = "wv AS (SELECT ((p_partkey * 37) % 41 / 400.0::DOUBLE + 0.05) * (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) AS kx, ((p_partkey * 29) % 41 / 400.0::DOUBLE + 0.05) * (CASE WHEN (p_partkey * 3) % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN p_partkey % 4 < 2 THEN 1 ELSE -1 END) AS ky, ((p_partkey * 23) % 41 / 400.0::DOUBLE + 0.05) * (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN p_partkey % 8 < 4 THEN 1 ELSE -1 END) AS kz, (p_partkey * 17) % 63 / 10.0::DOUBLE AS phase FROM part WHERE p_partkey < 24)"
_DEPTH = "(SELECT 24 + count(*) // 4 FROM supplier)"


def _depth(spark, d) -> int:
    """Volumes are deeper where there are more suppliers."""
    return 24 + table(spark, d, "supplier").count() // 4


@query("wave_volume", f"WITH {_WAVES} SELECT CAST(x.i AS INT) AS x, CAST(y.i AS INT) AS y, CAST(z.i AS INT) AS z, round(100 + 10 * sum(cos(kx * x.i + ky * y.i + kz * z.i + phase)), 6) AS v FROM wv, range(20) x(i), range(20) y(i), range({_DEPTH}) z(i) GROUP BY ALL")
def wave_volume(spark, d):
    return voxel_rows(c.wave_bricks(spark, waves(spark, d), (20, 20, _depth(spark, d)), 16), 16).select("x", "y", "z", rd(C("v"), 6).alias("v"))


@query("read_brick", f"WITH {_WAVES} SELECT CAST(x.i AS INT) AS x, CAST(y.i AS INT) AS y, CAST(z.i AS INT) AS z, round(100 + 10 * sum(cos(kx * x.i + ky * y.i + kz * z.i + phase)), 6) AS v FROM wv, range(10, 22) x(i), range(3, 9) y(i), range(14, {_DEPTH}) z(i) GROUP BY ALL")
def read_brick(spark, d):
    """A box across bricks: only the bricks it covers are looked at, each cut by itself."""
    lo, hi = (10, 3, 14), (22, 9, _depth(spark, d))
    return voxel_rows(in_box(c.wave_bricks(spark, waves(spark, d), (24, 24, hi[2]), 8), lo, hi, 8), 8, lo, hi).select("x", "y", "z", rd(C("v"), 6).alias("v"))
