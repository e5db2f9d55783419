"""Geometry of points, boxes, lattices, rotations and warps as column expressions.

Points and vectors are (x, y, z) in voxels; boxes are half-open and named by axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Matrix = list[list[Column]]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def box(**bounds: Column) -> Column:
    """A box struct from ``x=(lo, hi)``, ``y=...``, ``z=...``."""
    return F.struct(*[F.struct(*[c.cast("long").alias(n) for c, n in zip(bounds[a], ("lo", "hi"), strict=True)]).alias(a) for a in AXES])


def box_grow(b: Column, margin: Column | tuple) -> Column:
    """A margin (one, or one for each axis) on every side, rounded outward."""
    m = dict(zip(AXES, margin if isinstance(margin, tuple) else (margin,) * 3, strict=True))
    return box(**{a: (b[a]["lo"] - F.ceil(_c(m[a])), b[a]["hi"] + F.ceil(_c(m[a]))) for a in AXES})


def box_shift(b: Column, by: tuple) -> Column:
    """Moved by a displacement, rounded outward."""
    d = dict(zip(AXES, by, strict=True))
    return box(**{a: (F.floor(b[a]["lo"] + _c(d[a])), F.ceil(b[a]["hi"] + _c(d[a]))) for a in AXES})


def box_intersect(p: Column, q: Column) -> Column:
    """The common box, null if it is empty."""
    both = {a: (F.greatest(p[a]["lo"], q[a]["lo"]), F.least(p[a]["hi"], q[a]["hi"])) for a in AXES}
    some = both["x"][0] < both["x"][1]
    for a in ("y", "z"):
        some = some & (both[a][0] < both[a][1])
    return F.when(some, box(**both))


def box_around(lo: tuple, hi: tuple) -> Column:
    """The smallest box of the voxels with coordinates from ``lo`` to ``hi``."""
    return box(**{a: (F.ceil(_c(x)), F.floor(_c(y)) + 1) for a, x, y in zip(AXES, lo, hi, strict=True)})


def box_voxels(b: Column) -> Column:
    n = F.lit(1).cast("long")
    for a in AXES:
        n = n * (b[a]["hi"] - b[a]["lo"])
    return n


def halo(geometry: Column, size: Column, aspect: tuple, disp_max: Column) -> Column:
    """How far around a point a solve may read: farthest sample, largest displacement, cubic stencil."""
    a = [_c(v) for v in aspect]
    diagonal = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return F.when(geometry == "cube", size / 2 * diagonal).otherwise(size / 2 * F.greatest(*a)) + disp_max + 2


def lattice_spacing(size: Column, aspect: Column, overlap: Column) -> Column:
    return F.when((overlap >= 0) & (overlap < 1), size * aspect * (1 - overlap))


def product(*ms: Matrix) -> Matrix:
    out = ms[0]
    for m in ms[1:]:
        out = [[sum((out[i][k] * m[k][j] for k in range(1, 3)), out[i][0] * m[0][j]) for j in range(3)] for i in range(3)]
    return out


def _turn(axis: int, angle: Column, sign: int) -> Matrix:
    """A turn about an axis; ``sign`` 1: column-vector rotation, -1: its transpose (direction cosines)."""
    c, s = F.cos(angle), F.sin(angle) * sign
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m = [[F.lit(1.0) if r == k else F.lit(0.0) for k in range(3)] for r in range(3)]
    m[i][i], m[j][j], m[i][j], m[j][i] = c, c, -s, s
    return m


def lattice_rotation(degrees: tuple[Column, Column, Column]) -> Matrix:
    """About x, then y, then z."""
    a = [d * (math.pi / 180) for d in degrees]
    return product(_turn(2, a[2], 1), _turn(1, a[1], 1), _turn(0, a[0], 1))


def warp_rotation(phi: Column, the: Column, psi: Column) -> Matrix:
    """Direction cosines Rx(psi) Ry(the) Rz(phi): yaw, pitch, roll."""
    return product(_turn(0, psi, -1), _turn(1, the, -1), _turn(2, phi, -1))


def strain_matrix(exx, eyy, ezz, exy, eyz, exz) -> Matrix:
    return [[exx, exy, exz], [exy, eyy, eyz], [exz, eyz, ezz]]


def deformation(rotation: Matrix | None = None, strain: Matrix | None = None) -> Matrix:
    """(I + E) R; the identity without a rotation."""
    if rotation is None:
        return [[F.lit(1.0) if i == j else F.lit(0.0) for j in range(3)] for i in range(3)]
    if strain is None:
        return rotation
    return product([[strain[i][j] + (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)], rotation)


def apply(m: Matrix, d: tuple) -> list[Column]:
    return [m[i][0] * d[0] + m[i][1] * d[1] + m[i][2] * d[2] for i in range(3)]


def cubic_weights(t: Column) -> tuple[list[Column], list[Column]]:
    """Catmull-Rom weights of the taps at -1, 0, 1, 2 and their derivatives."""
    t2, t3 = t * t, t * t * t
    w = [-t3 + 2 * t2 - t, 3 * t3 - 5 * t2 + 2, -3 * t3 + 4 * t2 + t, t3 - t2]
    d = [-3 * t2 + 4 * t - 1, 9 * t2 - 10 * t, -9 * t2 + 8 * t + 1, 3 * t2 - 2 * t]
    return [x * 0.5 for x in w], [x * 0.5 for x in d]


def linear_weights(t: Column) -> tuple[list[Column], list[Column]]:
    return [1 - t, t], [F.lit(-1.0), F.lit(1.0)]


def stencil_inside(base: tuple, before: int, after: int, shape: tuple) -> Column:
    """Whether taps from base - before to base + after lie inside [0, n)."""
    ok = F.lit(True)
    for b, n in zip(base, shape, strict=True):
        ok = ok & (b - before >= 0) & (b + after <= n - 1)
    return ok


def edge_mask(xyz: tuple, uvw: tuple, shape: tuple, reach) -> Column:
    """Whether the point or the moved point, grown by ``reach``, leaves [0, n - 1]; a NaN displacement counts as none."""
    out = F.lit(False)
    for p, d, n in zip(xyz, uvw, shape, strict=True):
        for c in (p, p + F.nanvl(d, F.lit(0.0))):
            out = out | (c - reach < 0) | (c + reach > n - 1)
    return out


def spread_bits(v: Column) -> Column:
    """Two zero bits between the low 21 bits."""
    v = v.bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(ix: Column, iy: Column, iz: Column) -> Column:
    return spread_bits(ix).bitwiseOR(F.shiftleft(spread_bits(iy), 1)).bitwiseOR(F.shiftleft(spread_bits(iz), 2))


def to_levels(v: Column, lo: float, hi: float) -> Column:
    """Nearest whole grey level (halves to even), clipped."""
    return F.least(F.greatest(F.rint(v), F.lit(float(lo))), F.lit(float(hi)))
