"""Analytic displacement fields, their gradients and inverses at every point."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrvox.functions.fields import Inclusion, Linear, Sinusoid
from corrvox.plans.fixtures import PTS, pts, rd
from corrvox.plans.registry import query

C = F.col


def P():
    return C("x"), C("y"), C("z")


AFFINE = Linear((1.25, -0.5, 0.25), [[0.015625, 0.0078125, 0.0], [0.0078125, -0.03125, 0.00390625], [0.0, 0.00390625, 0.015625]], (80.0, 80.0, 96.0))
WAVE = Sinusoid((0.5, 0.0, -0.25), 1.0, 160.0, axis=0, component=1, phase=0.5)
BALL = Inclusion((0.25, 0.0, 0.0), (80.0, 80.0, 96.0), 32.0, [[0.03125, 0.0, 0.0], [0.0, -0.015625, 0.0], [0.0, 0.0, -0.015625]], 0.25)


def _field(field, digits=9):
    return [rd(v, digits).alias(n) for n, v in zip("uvw", field(P()), strict=True)]


@query("field_affine", f"WITH {PTS}, d AS (SELECT *, x - 80 AS dx, y - 80 AS dy, z - 96 AS dz FROM pts) SELECT point_id, round(1.25 + 0.015625::DOUBLE * dx + 0.0078125::DOUBLE * dy, 9) + 0.0 AS u, round(-0.5 + 0.0078125::DOUBLE * dx - 0.03125::DOUBLE * dy + 0.00390625::DOUBLE * dz, 9) + 0.0 AS v, round(0.25 + 0.00390625::DOUBLE * dy + 0.015625::DOUBLE * dz, 9) + 0.0 AS w FROM d")
def field_affine(spark, d):
    return pts(spark, d).select("point_id", *_field(AFFINE))


_W = "2 * pi() / 160 * x + 0.5"


@query("field_sinusoid", f"WITH {PTS} SELECT point_id, 0.5::DOUBLE AS u, round(sin({_W}), 9) + 0.0 AS v, -0.25::DOUBLE AS w, round(2 * pi() / 160 * cos({_W}), 9) + 0.0 AS dv_dx FROM pts")
def field_sinusoid(spark, d):
    return pts(spark, d).select("point_id", *_field(WAVE), rd(WAVE.gradient(P())[1][0]).alias("dv_dx"))


_S = "CASE WHEN r > 32 THEN 1 - 0.75::DOUBLE * pow(32 / r, 3) ELSE 0.25::DOUBLE END"
_DS = "CASE WHEN r > 32 THEN 3 * 0.75::DOUBLE * 32768 / pow(r, 4) ELSE 0 END"
_BALL = f"d AS (SELECT *, x - 80 AS dx, y - 80 AS dy, z - 96 AS dz FROM pts), b AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM d), s AS (SELECT *, {_S} AS s, {_DS} AS ds FROM b)"


@query("field_inclusion", f"WITH {PTS}, {_BALL} SELECT point_id, round(0.25 + s * 0.03125::DOUBLE * dx, 9) + 0.0 AS u, round(s * -0.015625::DOUBLE * dy, 9) + 0.0 AS v, round(s * -0.015625::DOUBLE * dz, 9) + 0.0 AS w, round(s * 0.03125::DOUBLE + ds / greatest(r, 1e-12) * 0.03125::DOUBLE * dx * dx, 9) + 0.0 AS du_dx, round(ds / greatest(r, 1e-12) * 0.03125::DOUBLE * dx * dy, 9) + 0.0 AS du_dy FROM s")
def field_inclusion(spark, d):
    m = BALL.gradient(P())
    return pts(spark, d).select("point_id", *_field(BALL), rd(m[0][0]).alias("du_dx"), rd(m[0][1]).alias("du_dy"))


@query("field_gradient_affine", f"WITH {PTS} SELECT point_id, 0.015625::DOUBLE AS exx, -0.03125::DOUBLE AS eyy, 0.015625::DOUBLE AS ezz, 0.0078125::DOUBLE AS exy FROM pts")
def field_gradient_affine(spark, d):
    m = AFFINE.gradient(P())
    return pts(spark, d).select("point_id", rd(m[0][0]).alias("exx"), rd(m[1][1]).alias("eyy"), rd(m[2][2]).alias("ezz"), rd((m[0][1] + m[1][0]) / 2).alias("exy"))




@query("inverse_map", f"WITH {PTS} SELECT point_id, round(x - 0.5, 8) + 0.0 AS x, round(y - sin(2 * pi() / 160 * (x - 0.5) + 0.5), 8) + 0.0 AS y, round(z + 0.25, 8) + 0.0 AS z FROM pts")
def inverse_map(spark, d):
    """The sinusoid's displacement depends on x alone and moves x by a constant, so its inverse has a closed form to hold against."""
    return pts(spark, d).select("point_id", *[rd(v, 8).alias(a) for a, v in zip("xyz", WAVE.inverse(P()), strict=True)])


@query("max_displacement", f"""
WITH {PTS}, d AS (SELECT x - 80 AS dx, y - 80 AS dy, z - 96 AS dz FROM pts),
f AS (SELECT 1.25 + 0.015625::DOUBLE * dx + 0.0078125::DOUBLE * dy AS u, -0.5 + 0.0078125::DOUBLE * dx - 0.03125::DOUBLE * dy + 0.00390625::DOUBLE * dz AS v, 0.25 + 0.00390625::DOUBLE * dy + 0.015625::DOUBLE * dz AS w FROM d)
SELECT round(max(sqrt(u * u + v * v + w * w)), 9) AS max_displacement FROM f""")
def max_displacement(spark, d):
    """The largest displacement of a field over the points of a cloud."""
    u = AFFINE(P())
    return pts(spark, d).agg(rd(F.max(F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2]))).alias("max_displacement"))
