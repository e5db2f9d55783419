"""Per-row geometry: boxes, lattices, rotations, warps, weights, codes and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrvox.functions import geometry as g
from corrvox.operators.tables import dealt
from corrvox.plans.fixtures import PTS, RESULTS, STENCIL, TRUTH, div, pts, rd, res_a, res_b, stencil, table, truth
from corrvox.plans.registry import query

C = F.col


@query("status_to_ccpi", "SELECT event_id, CAST(-(event_id % 6) AS INT) AS status, CAST(greatest(-(event_id % 6), -3) AS INT) AS code FROM events")
def status_to_ccpi(spark, d):
    s = -(C("event_id") % 6)
    return table(spark, d, "events").select("event_id", s.cast("int").alias("status"), F.greatest(s, F.lit(-3)).cast("int").alias("code"))


def _flat(b, name):
    return [b[a][e].alias(f"{name}_{a}_{e}") for a in g.AXES for e in ("lo", "hi")]


_AXES_SQL = ("x", "y", "z")
_GROWN = ", ".join(f"CAST(floor({a}) - ceil(m) AS BIGINT) AS grown_{a}_lo, CAST(floor({a}) + 20 + ceil(m) AS BIGINT) AS grown_{a}_hi" for a in _AXES_SQL)
_MOVED = ", ".join(f"CAST(floor(floor({a}) + {u}) AS BIGINT) AS moved_{a}_lo, CAST(ceil(floor({a}) + 20 + {u}) AS BIGINT) AS moved_{a}_hi" for a, u in zip(_AXES_SQL, "uvw", strict=True))


@query("box_ops", f"""
WITH {TRUTH}, b AS (SELECT *, (point_id % 7) / 2.0::DOUBLE AS m FROM truth), k AS (SELECT point_id, {_GROWN}, {_MOVED} FROM b),
c AS (SELECT *, greatest(grown_x_lo, 10) AS xl, least(grown_x_hi, 90) AS xh, greatest(grown_y_lo, 10) AS yl, least(grown_y_hi, 90) AS yh, greatest(grown_z_lo, 10) AS zl, least(grown_z_hi, 90) AS zh FROM k)
SELECT point_id, {", ".join(f"{n}_{a}_{e}" for n in ("grown", "moved") for a in _AXES_SQL for e in ("lo", "hi"))},
  CASE WHEN xl < xh AND yl < yh AND zl < zh THEN (xh - xl) * (yh - yl) * (zh - zl) END AS common_voxels FROM c""")
def box_ops(spark, d):
    b = g.box(**{a: (F.floor(a), F.floor(a) + 20) for a in g.AXES})
    t = truth(pts(spark, d)).withColumn("b", b)
    fixed = g.box(x=(F.lit(10), F.lit(90)), y=(F.lit(10), F.lit(90)), z=(F.lit(10), F.lit(90)))
    t = t.withColumn("grown", g.box_grow(C("b"), (C("point_id") % 7) / 2)).withColumn("moved", g.box_shift(C("b"), (C("u"), C("v"), C("w"))))
    t = t.withColumn("common", g.box_intersect(C("grown"), fixed))
    return t.select("point_id", *_flat(C("grown"), "grown"), *_flat(C("moved"), "moved"), g.box_voxels(C("common")).alias("common_voxels"))


@query("box_around_points", f"WITH {TRUTH} SELECT CAST(floor(z / 64) AS BIGINT) AS slab, " + ", ".join(f"CAST(ceil(min({a} + {u})) AS BIGINT) AS {a}_lo, CAST(floor(max({a} + {u})) + 1 AS BIGINT) AS {a}_hi" for a, u in zip("xyz", "uvw", strict=True)) + " FROM truth GROUP BY ALL")
def box_around_points(spark, d):
    t = truth(pts(spark, d)).groupBy(div(C("z"), 64).alias("slab"))
    lo = [F.min(C(a) + C(u)).alias(f"lo_{a}") for a, u in zip("xyz", "uvw", strict=True)]
    hi = [F.max(C(a) + C(u)).alias(f"hi_{a}") for a, u in zip("xyz", "uvw", strict=True)]
    b = g.box_around(tuple(C(f"lo_{a}") for a in "xyz"), tuple(C(f"hi_{a}") for a in "xyz"))
    return t.agg(*lo, *hi).select("slab", b.alias("b")).select("slab", *[C(f"b.{a}.{e}").alias(f"{a}_{e}") for a in "xyz" for e in ("lo", "hi")])


@query("halo", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cube' ELSE 'sphere' END AS geometry, CAST(p_size AS DOUBLE) AS size, 1 + (p_partkey % 3) / 4.0::DOUBLE AS ax, 1 + (p_partkey % 5) / 4.0::DOUBLE AS ay, (p_partkey % 9) / 2.0::DOUBLE AS dm FROM part)
SELECT p_partkey, geometry, round(CASE WHEN geometry = 'cube' THEN size / 2 * sqrt(ax * ax + ay * ay + 1) ELSE size / 2 * greatest(ax, ay, 1) END + dm + 2, 9) AS halo FROM p""")
def halo(spark, d):
    k = C("p_partkey")
    geometry = F.when(k % 2 == 0, "cube").otherwise("sphere")
    aspect = (1 + (k % 3) / 4, 1 + (k % 5) / 4, 1.0)
    return table(spark, d, "part").select("p_partkey", geometry.alias("geometry"), rd(g.halo(geometry, C("p_size").cast("double"), aspect, (k % 9) / 2)).alias("halo"))


@query("lattice_spacing", "SELECT p_partkey, (p_partkey % 12) / 10.0::DOUBLE AS overlap, CASE WHEN (p_partkey % 12) / 10.0::DOUBLE < 1 THEN round(p_size * (1 + (p_partkey % 3) / 4.0::DOUBLE) * (1 - (p_partkey % 12) / 10.0::DOUBLE), 9) END AS spacing FROM part")
def lattice_spacing(spark, d):
    k = C("p_partkey")
    overlap = (k % 12) / 10
    return table(spark, d, "part").select("p_partkey", overlap.alias("overlap"), rd(g.lattice_spacing(C("p_size").cast("double"), 1 + (k % 3) / 4, overlap)).alias("spacing"))


def _entries(m, name="r"):
    return [rd(m[i][j]).alias(f"{name}{i}{j}") for i in range(3) for j in range(3)]


_ANGLES = "a AS (SELECT event_id, (event_id % 61 - 30) / 64.0::DOUBLE AS phi, (event_id % 53 - 26) / 64.0::DOUBLE AS the, (event_id % 47 - 23) / 64.0::DOUBLE AS psi FROM events), cs AS (SELECT *, cos(phi) AS c1, sin(phi) AS s1, cos(the) AS c2, sin(the) AS s2, cos(psi) AS c3, sin(psi) AS s3 FROM a)"
# Rows of Rx(psi) Ry(the) Rz(phi), written out.
_R = [["c2 * c1", "c2 * s1", "-s2"], ["s3 * s2 * c1 - c3 * s1", "s3 * s2 * s1 + c3 * c1", "s3 * c2"], ["c3 * s2 * c1 + s3 * s1", "c3 * s2 * s1 - s3 * c1", "c3 * c2"]]


def _angles():
    e = C("event_id")
    return (e % 61 - 30) / 64, (e % 53 - 26) / 64, (e % 47 - 23) / 64


@query("rotation_matrix", f"WITH {_ANGLES} SELECT event_id, " + ", ".join(f"round({_R[i][j]}, 9) + 0.0 AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM cs")
def rotation_matrix(spark, d):
    return table(spark, d, "events").select("event_id", *_entries(g.warp_rotation(*_angles())))


@query("euler_matrix_lattice", """
WITH a AS (SELECT event_id, radians((event_id % 91 - 45)::DOUBLE) AS ax, radians((event_id % 71 - 35)::DOUBLE) AS ay, radians((event_id % 181 - 90)::DOUBLE) AS az FROM events)
SELECT event_id, round(cos(az) * cos(ay), 9) + 0.0 AS r00, round(cos(az) * sin(ay) * sin(ax) - sin(az) * cos(ax), 9) + 0.0 AS r01, round(cos(az) * sin(ay) * cos(ax) + sin(az) * sin(ax), 9) + 0.0 AS r02,
 round(sin(az) * cos(ay), 9) + 0.0 AS r10, round(sin(az) * sin(ay) * sin(ax) + cos(az) * cos(ax), 9) + 0.0 AS r11, round(sin(az) * sin(ay) * cos(ax) - cos(az) * sin(ax), 9) + 0.0 AS r12,
 round(-sin(ay), 9) + 0.0 AS r20, round(cos(ay) * sin(ax), 9) + 0.0 AS r21, round(cos(ay) * cos(ax), 9) + 0.0 AS r22 FROM a""")
def euler_matrix_lattice(spark, d):
    e = C("event_id")
    return table(spark, d, "events").select("event_id", *_entries(g.lattice_rotation(((e % 91 - 45).cast("double"), (e % 71 - 35).cast("double"), (e % 181 - 90).cast("double")))))


_E = [["exx", "exy", "exz"], ["exy", "eyy", "eyz"], ["exz", "eyz", "ezz"]]
_STRAINS = "s AS (SELECT *, (event_id % 11) / 256.0::DOUBLE AS exx, (event_id % 13) / 256.0::DOUBLE AS eyy, (event_id % 17) / 256.0::DOUBLE AS ezz, (event_id % 7) / 512.0::DOUBLE AS exy, (event_id % 5) / 512.0::DOUBLE AS eyz, (event_id % 3) / 512.0::DOUBLE AS exz FROM cs)"
_F = [[" + ".join(f"({_E[i][k]}{' + 1' if i == k else ''}) * ({_R[k][j]})" for k in range(3)) for j in range(3)] for i in range(3)]


def _strain():
    e = C("event_id")
    return g.strain_matrix((e % 11) / 256, (e % 13) / 256, (e % 17) / 256, (e % 7) / 512, (e % 5) / 512, (e % 3) / 512)


@query("deformation_matrix", f"WITH {_ANGLES}, {_STRAINS} SELECT event_id, " + ", ".join(f"round({_F[i][j]}, 9) + 0.0 AS f{i}{j}" for i in range(3) for j in range(3)) + " FROM s")
def deformation_matrix(spark, d):
    return table(spark, d, "events").select("event_id", *_entries(g.deformation(g.warp_rotation(*_angles()), _strain()), "f"))


_OFFSETS = "o AS (SELECT CAST(a.i * 9 + b.i * 3 + c.i AS INT) AS sample, 4.0::DOUBLE * (c.i - 1) AS dx, 4.0::DOUBLE * (b.i - 1) AS dy, 4.0::DOUBLE * (a.i - 1) AS dz FROM range(3) a(i), range(3) b(i), range(3) c(i))"


@query("warp", f"WITH {TRUTH}, {_ANGLES}, {_STRAINS}, {_OFFSETS} SELECT point_id, sample, " + ", ".join(f"round({a} + {u} + ({_F[i][0]}) * dx + ({_F[i][1]}) * dy + ({_F[i][2]}) * dz, 8) + 0.0 AS {a}" for i, (a, u) in enumerate(zip("xyz", "uvw", strict=True))) + " FROM truth t JOIN s ON s.event_id = t.point_id, o")
def warp(spark, d):
    """Points x template: the template is a literal array of 27 offsets, so no join is needed."""
    m = g.deformation(g.warp_rotation(*_angles()), _strain())
    t = truth(pts(spark, d)).withColumn("event_id", C("point_id"))
    t = t.select("point_id", *[(C(a) + C(u)).alias(a) for a, u in zip("xyz", "uvw", strict=True)], *[m[i][j].alias(f"f{i}{j}") for i in range(3) for j in range(3)])
    t = t.select("*", F.posexplode(cube_template(F.lit(3), F.lit(8.0))).alias("sample", "o"))
    f = [[C(f"f{i}{j}") for j in range(3)] for i in range(3)]
    moved = g.apply(f, (C("o.x"), C("o.y"), C("o.z")))
    return t.select("point_id", "sample", *[rd(C(a) + v, 8).alias(a) for a, v in zip("xyz", moved, strict=True)])


def cube_axis(k, size):
    """The k places of a cube's samples along an axis."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, (i / F.greatest(k - 1, F.lit(1)) * 2 - 1) * size / 2).otherwise(F.lit(0.0)))


def cubes(rows, axis, sample):
    """A row for each sample of each row's cube, numbered by ``sample`` in z, y, x order, with its places along the axes: ``axis``, an
    array of them, is made once for a row, and a sample only looks its places up."""
    side = F.size("_axis")
    t = dealt(rows).withColumn("_axis", axis)
    t = t.withColumn(sample, F.explode(F.sequence(F.lit(0), side * side * side - 1)))
    at = {a: F.pmod(F.floor(C(sample) / step), side).cast("int") for a, step in (("x", F.lit(1)), ("y", side), ("z", side * side))}
    return t.select(*rows.columns, sample, *[F.get("_axis", i).alias(a) for a, i in at.items()])


def cube_template(k, size):
    """Offsets of a cube of k**3 samples in z, y, x order, as an array of structs."""
    axis = cube_axis(k, size)
    return F.flatten(F.flatten(F.transform(axis, lambda z: F.transform(axis, lambda y: F.transform(axis, lambda x: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


@query("cube_template", """
WITH p AS (SELECT p_partkey, p_size, 1 + p_partkey % 300 AS n FROM part), k AS (SELECT p_partkey, p_size, n, min(k) AS k FROM p, range(1, 8) r(k) WHERE k * k * k >= n GROUP BY ALL)
SELECT p_partkey, CAST(k AS INT) AS k, CAST(z.i * k * k + y.i * k + x.i AS INT) AS sample, """ + ", ".join(f"round(CASE WHEN k > 1 THEN ({a}.i / greatest(k - 1, 1)::DOUBLE * 2 - 1) * p_size / 2 ELSE 0 END, 9) + 0.0 AS {a}" for a in "xyz") + " FROM k, range(7) z(i), range(7) y(i), range(7) x(i) WHERE z.i < k AND y.i < k AND x.i < k")
def cube_template_query(spark, d):
    n = 1 + C("p_partkey") % 300
    k = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i * i * i >= n))
    p = table(spark, d, "part").select("p_partkey", k.alias("k"), C("p_size").cast("double").alias("size"))
    places = F.transform(cube_axis(C("k"), C("size")), lambda v: rd(v))
    return cubes(p, places, "sample").select("p_partkey", C("k").cast("int").alias("k"), "sample", *"xyz")


@query("warp_jacobian", f"WITH {_ANGLES} SELECT event_id, " + ", ".join(
    f"round({e}, 9) + 0.0 AS {n}" for n, e in (
        ("phi_x", "-c2 * s1 * 4 + c2 * c1 * -2"), ("phi_y", "(-s3 * s2 * s1 - c3 * c1) * 4 + (s3 * s2 * c1 - c3 * s1) * -2"), ("phi_z", "(-c3 * s2 * s1 + s3 * c1) * 4 + (c3 * s2 * c1 + s3 * s1) * -2"),
        ("the_x", "-s2 * c1 * 4 + -s2 * s1 * -2 + -c2 * 3"), ("the_y", "s3 * c2 * c1 * 4 + s3 * c2 * s1 * -2 + -s3 * s2 * 3"), ("the_z", "c3 * c2 * c1 * 4 + c3 * c2 * s1 * -2 + -c3 * s2 * 3"),
        ("psi_x", "0"), ("psi_y", "(c3 * s2 * c1 + s3 * s1) * 4 + (c3 * s2 * s1 - s3 * c1) * -2 + c3 * c2 * 3"), ("psi_z", "(-s3 * s2 * c1 + c3 * s1) * 4 + (-s3 * s2 * s1 - c3 * c1) * -2 + -s3 * c2 * 3"))) + " FROM cs")
def warp_jacobian(spark, d):
    """Derivatives of R d by the three angles, at d = (4, -2, 3): each factor of R is replaced by its own derivative."""
    phi, the, psi = _angles()
    turn = {n: (axis, a) for n, axis, a in (("phi", 2, phi), ("the", 1, the), ("psi", 0, psi))}

    def slope(axis, a):
        c, s = F.cos(a), F.sin(a)
        i, j = (axis + 1) % 3, (axis + 2) % 3
        m = [[F.lit(0.0)] * 3 for _ in range(3)]
        m[i][i], m[j][j], m[i][j], m[j][i] = -s, -s, c, -c
        return m

    cols = []
    for n in turn:
        factors = [slope(*turn[k]) if k == n else g._turn(*turn[k], -1) for k in ("psi", "the", "phi")]
        cols += [rd(v).alias(f"{n}_{a}") for a, v in zip("xyz", g.apply(g.product(*factors), (4, -2, 3)), strict=True)]
    return table(spark, d, "events").select("event_id", *cols)


@query("interpolation_weights", f"""WITH {STENCIL} SELECT vec_id, round((-tx*tx*tx + 2*tx*tx - tx) / 2, 9) + 0.0 AS w0, round((3*tx*tx*tx - 5*tx*tx + 2) / 2, 9) + 0.0 AS w1, round((-3*tx*tx*tx + 4*tx*tx + tx) / 2, 9) + 0.0 AS w2, round((tx*tx*tx - tx*tx) / 2, 9) + 0.0 AS w3,
round((-3*tx*tx + 4*tx - 1) / 2, 9) + 0.0 AS d0, round((9*tx*tx - 10*tx) / 2, 9) + 0.0 AS d1, round((-9*tx*tx + 8*tx + 1) / 2, 9) + 0.0 AS d2, round((3*tx*tx - 2*tx) / 2, 9) + 0.0 AS d3, round(1 - tx, 9) AS l0, round(tx, 9) AS l1 FROM stencil""")
def interpolation_weights(spark, d):
    w, dw = g.cubic_weights(C("tx"))
    lw, _ = g.linear_weights(C("tx"))
    return stencil(spark, d).select("vec_id", *[rd(x).alias(f"w{k}") for k, x in enumerate(w)], *[rd(x).alias(f"d{k}") for k, x in enumerate(dw)], *[rd(x).alias(f"l{k}") for k, x in enumerate(lw)])


@query("inside_mask", f"WITH {TRUTH} SELECT point_id, " + ", ".join(
    f"(floor(x + u{h}) - {b} >= 0 AND floor(x + u{h}) + {a} <= 159 AND floor(y + v{h}) - {b} >= 0 AND floor(y + v{h}) + {a} <= 159 AND floor(z + w{h}) - {b} >= 0 AND floor(z + w{h}) + {a} <= 199) AS {n}" for n, b, a, h in (("nearest", 0, 0, " + 0.5"), ("trilinear", 0, 1, ""), ("tricubic", 1, 2, ""))) + " FROM truth")
def inside_mask(spark, d):
    at = [C(a) + C(u) for a, u in zip("xyz", "uvw", strict=True)]
    cols = [g.stencil_inside(tuple(F.floor(p + h) for p in at), b, a, (160, 160, 200)).alias(n) for n, b, a, h in (("nearest", 0, 0, 0.5), ("trilinear", 0, 1, 0.0), ("tricubic", 1, 2, 0.0))]
    return truth(pts(spark, d)).select("point_id", *cols)


@query("range_test", f"WITH {RESULTS} SELECT point_id, greatest(abs(a.u - b.u), abs(a.v - b.v), abs(a.w - b.w)) > 0.03 AS out_of_range FROM res_a a JOIN res_b b USING (point_id)")
def range_test(spark, d):
    a, b = res_a(spark, d).alias("a"), res_b(spark, d).alias("b")
    far = F.greatest(*[F.abs(C(f"a.{c}") - C(f"b.{c}")) for c in "uvw"]) > 0.03
    return a.join(b, "point_id").select("point_id", far.alias("out_of_range"))


@query("edge_mask", f"WITH {RESULTS} SELECT point_id, (x - 6 < 0 OR x + 6 > 159 OR y - 6 < 0 OR y + 6 > 159 OR z - 6 < 0 OR z + 6 > 199 OR x + u - 6 < 0 OR x + u + 6 > 159 OR y + v - 6 < 0 OR y + v + 6 > 159 OR z + w - 6 < 0 OR z + w + 6 > 199) AS edge FROM res_a")
def edge_mask(spark, d):
    return res_a(spark, d).select("point_id", g.edge_mask((C("x"), C("y"), C("z")), (C("u"), C("v"), C("w")), (160, 160, 200), 6.0).alias("edge"))


@query("grid_offsets", """
WITH p AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS dm, greatest(1, CAST(floor(p_size / 4.0::DOUBLE / (2 + p_partkey % 5)) AS INT)) AS n FROM part)
SELECT p_partkey, CAST(n AS INT) AS n, CAST((2*n+1)*(2*n+1)*(z+n) + (2*n+1)*(y+n) + x+n AS INT) AS g, round(x * dm / n, 9) + 0.0 AS dx, round(y * dm / n, 9) + 0.0 AS dy, round(z * dm / n, 9) + 0.0 AS dz
FROM p, range(-8, 9) a(x), range(-8, 9) b(y), range(-8, 9) c(z) WHERE abs(x) <= n AND abs(y) <= n AND abs(z) <= n""")
def grid_offsets(spark, d):
    dm, n = C("p_size") / 4, F.greatest(F.lit(1), F.floor(C("p_size") / 4 / (2 + C("p_partkey") % 5))).cast("int")
    p = table(spark, d, "part").select("p_partkey", n.alias("n"), (dm / n).alias("step"))
    places = F.transform(F.sequence(-C("n"), C("n")), lambda i: rd(i * C("step")))
    return cubes(p, places, "g").select("p_partkey", "n", "g", *[C(a).alias(f"d{a}") for a in "xyz"])


@query("to_levels", "SELECT event_id, CAST(least(greatest(round_even(value * 3 - 40, 0), 0), 255) AS BIGINT) AS u8, CAST(least(greatest(round_even(value * 4 - 100, 0), -128), 127) AS BIGINT) AS i8 FROM events")
def to_levels(spark, d):
    return table(spark, d, "events").select("event_id", g.to_levels(C("value") * 3 - 40, 0, 255).cast("long").alias("u8"), g.to_levels(C("value") * 4 - 100, -128, 127).cast("long").alias("i8"))


_SPREAD = "list_sum(list_transform(range(21), lambda b: (({v} >> b) & 1) << (3 * b + {s})))"
MORTON_SQL = " + ".join(_SPREAD.format(v=f"CAST(floor({a} / 12.0) AS BIGINT)", s=s) for s, a in enumerate("xyz"))


def morton(df, cell):
    """Z-order code of points quantised to ``cell`` voxels from the cloud's lower corner (one row of minima, broadcast)."""
    low = df.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"])
    q = [F.floor((C(a) - C(f"lo_{a}")) / cell).cast("long") for a in "xyz"]
    return df.join(F.broadcast(low)).select(*df.columns, g.morton_code(*q).alias("code"))


@query("morton_code", f"WITH {PTS} SELECT point_id, CAST({MORTON_SQL} AS BIGINT) AS code FROM pts")
def morton_code(spark, d):
    return morton(pts(spark, d), 12.0).select("point_id", "code")


@query("batch_size", """
SELECT p_partkey, CAST(greatest(1, (p_size * 10000000 // 2) // ((100 + p_partkey % 900) * 9 + 4 * (2 * dof + dof * (dof + 1) // 2 + 3 * dof + 7 + 16))) AS BIGINT) AS points
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END AS dof FROM part)""")
def batch_size(spark, d):
    """Points per batch for a share of free memory: samples, parameters, state and one row of sums for each point."""
    k = C("p_partkey")
    dof = F.when(k % 3 == 0, 3).when(k % 3 == 1, 6).otherwise(12)
    sums = dof * (dof + 1) / 2 + 3 * dof + 7
    per_point = (100 + k % 900) * 9 + 4 * (2 * dof + sums + 16)
    free = F.floor(C("p_size").cast("double") * 10000000 / 2)
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(1), F.floor(free / per_point)).cast("long").alias("points"))


@query("check_memory", f"""
WITH {PTS}, t AS (SELECT floor(x / 64) AS tx, floor(y / 64) AS ty, floor(z / 64) AS tz, count(*) AS n, (max(x) - min(x) + 1 + 36) * (max(y) - min(y) + 1 + 36) * (max(z) - min(z) + 1 + 36) AS vox FROM pts GROUP BY ALL)
SELECT CAST(max(2 * vox * 2) AS BIGINT) AS brick_bytes, CAST(2 * max(2 * vox * 2) AS BIGINT) AS in_flight_bytes, CAST(max(n) * (500 * 9 + 4 * (24 + 128)) AS BIGINT) AS batch_bytes, 2 * max(2 * vox * 2) + max(n) * (500 * 9 + 4 * (24 + 128)) <= 8000000 AS fits FROM t""")
def check_memory(spark, d):
    """Bricks in flight and one batch against the memory that a worker may use."""
    t = pts(spark, d).groupBy(*[div(C(a), 64).alias(f"t{a}") for a in "xyz"])
    side = [F.max(a) - F.min(a) + 1 + 36 for a in "xyz"]
    t = t.agg(F.count(F.lit(1)).alias("n"), (side[0] * side[1] * side[2] * 2 * 2).alias("brick"))
    per_point = 500 * 9 + 4 * (2 * 12 + 128)
    m = t.agg(F.max("brick").cast("long").alias("brick_bytes"), (2 * F.max("brick")).cast("long").alias("in_flight_bytes"), (F.max("n") * per_point).cast("long").alias("batch_bytes"))
    return m.withColumn("fits", C("in_flight_bytes") + C("batch_bytes") <= 8_000_000)


@query("truth_case", f"WITH {PTS} SELECT point_id, round(CASE WHEN point_id % 2 = 0 THEN 0.5 ELSE 0.01::DOUBLE * (x - 79.5) END, 9) + 0.0 AS u, round(CASE WHEN point_id % 2 = 0 THEN 0.5 ELSE -0.005::DOUBLE * (y - 79.5) END, 9) + 0.0 AS v FROM pts")
def truth_case(spark, d):
    even = C("point_id") % 2 == 0
    return pts(spark, d).select("point_id", rd(F.when(even, 0.5).otherwise(0.01 * (C("x") - 79.5))).alias("u"), rd(F.when(even, 0.5).otherwise(-0.005 * (C("y") - 79.5))).alias("v"))


@query("iter_blocks", "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 100 + s_suppkey % 60 AS nx, 90 + s_suppkey % 50 AS ny, 110 + s_suppkey % 40 AS nz FROM supplier) SELECT k, CAST(z AS BIGINT) AS z0, least(z + 48, nz) AS z1, CAST(y AS BIGINT) AS y0, least(y + 64, ny) AS y1, CAST(x AS BIGINT) AS x0, least(x + 64, nx) AS x1 FROM s, range(0, 160, 48) a(z), range(0, 160, 64) b(y), range(0, 160, 64) c(x) WHERE z < nz AND y < ny AND x < nx")
def iter_blocks(spark, d):
    """Boxes that tile a volume, one for each supplier."""
    k = C("s_suppkey").cast("long")
    out = table(spark, d, "supplier").select(k.alias("k"), (100 + k % 60).alias("nx"), (90 + k % 50).alias("ny"), (110 + k % 40).alias("nz"))
    for a, step in (("z", 48), ("y", 64), ("x", 64)):
        out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), C(f"n{a}") - 1, F.lit(step).cast("long"))).alias(f"{a}0"))
    return out.select("k", *[c for a, step in (("z", 48), ("y", 64), ("x", 64)) for c in (C(f"{a}0"), F.least(C(f"{a}0") + step, C(f"n{a}")).cast("long").alias(f"{a}1"))])
