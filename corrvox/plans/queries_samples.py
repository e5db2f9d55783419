"""Sample-level numerics: interpolation, matching criteria, Gauss-Newton sums and steps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corrvox.functions import arrays as a
from corrvox.functions import geometry as g
from corrvox.plans.fixtures import STENCIL, SUBVOL, rd, stencil, subvol, table
from corrvox.plans.registry import query

C = F.col


def _contract(taps, weights, n, start, side=4):
    """Sum of taps times separable weights (x, y, z lists of n columns)."""
    wx, wy, wz = (F.array(*w) for w in weights)
    spots = [(i, j, k) for i in range(n) for j in range(n) for k in range(n)]
    at = F.array(*[F.struct(F.lit(((start + i) * side + start + j) * side + start + k + 1).alias("p"), F.lit(i + 1).alias("z"), F.lit(j + 1).alias("y"), F.lit(k + 1).alias("x")) for i, j, k in spots])
    return a.total(F.transform(at, lambda s: F.element_at(taps, s["p"]) * F.element_at(wx, s["x"]) * F.element_at(wy, s["y"]) * F.element_at(wz, s["z"])))


_CUBIC = {t: ([f"(-{t}*{t}*{t}+2*{t}*{t}-{t})/2", f"(3*{t}*{t}*{t}-5*{t}*{t}+2)/2", f"(-3*{t}*{t}*{t}+4*{t}*{t}+{t})/2", f"({t}*{t}*{t}-{t}*{t})/2"], [f"(-3*{t}*{t}+4*{t}-1)/2", f"(9*{t}*{t}-10*{t})/2", f"(-9*{t}*{t}+8*{t}+1)/2", f"(3*{t}*{t}-2*{t})/2"]) for t in ("tx", "ty", "tz")}
_LIST = {(t, k): "[" + ", ".join(_CUBIC[t][k]) + "]" for t in _CUBIC for k in (0, 1)}
_W = "w AS (SELECT vec_id, taps, tx, ty, tz, " + ", ".join(f"{_LIST[t, k]} AS {n}{t[1]}" for t in _CUBIC for k, n in ((0, "w"), (1, "d"))) + " FROM stencil), u AS (SELECT *, unnest(taps) AS v, generate_subscripts(taps, 1) - 1 AS i FROM w), s AS (SELECT *, i % 4 + 1 AS ix, (i // 4) % 4 + 1 AS iy, i // 16 + 1 AS iz FROM u)"


@query("interp_tricubic", f"WITH {STENCIL}, {_W} SELECT vec_id, round(sum(v * wx[ix] * wy[iy] * wz[iz]), 6) + 0.0 AS value, round(sum(v * dx[ix] * wy[iy] * wz[iz]), 6) + 0.0 AS gx, round(sum(v * wx[ix] * dy[iy] * wz[iz]), 6) + 0.0 AS gy, round(sum(v * wx[ix] * wy[iy] * dz[iz]), 6) + 0.0 AS gz FROM s GROUP BY vec_id")
def interp_tricubic(spark, d):
    w = {t: g.cubic_weights(C(f"t{t}")) for t in "xyz"}
    value = [w[t][0] for t in "xyz"]
    cols = [rd(_contract(C("taps"), value, 4, 0), 6).alias("value")]
    for k, t in enumerate("xyz"):
        cols.append(rd(_contract(C("taps"), [w[q][1] if q == t else value[j] for j, q in enumerate("xyz")], 4, 0), 6).alias(f"g{t}"))
    return stencil(spark, d).select("vec_id", *cols)


@query("interp_trilinear", f"WITH {STENCIL}, u AS (SELECT *, unnest(taps) AS v, generate_subscripts(taps, 1) - 1 AS i FROM stencil), s AS (SELECT *, i % 4 - 1 AS ix, (i // 4) % 4 - 1 AS iy, i // 16 - 1 AS iz FROM u) SELECT vec_id, round(sum(v * (CASE WHEN ix = 0 THEN 1 - tx ELSE tx END) * (CASE WHEN iy = 0 THEN 1 - ty ELSE ty END) * (CASE WHEN iz = 0 THEN 1 - tz ELSE tz END)), 6) + 0.0 AS value, round(sum(v * (CASE WHEN ix = 0 THEN -1 ELSE 1 END) * (CASE WHEN iy = 0 THEN 1 - ty ELSE ty END) * (CASE WHEN iz = 0 THEN 1 - tz ELSE tz END)), 6) + 0.0 AS gx FROM s WHERE ix BETWEEN 0 AND 1 AND iy BETWEEN 0 AND 1 AND iz BETWEEN 0 AND 1 GROUP BY vec_id")
def interp_trilinear(spark, d):
    w = {t: g.linear_weights(C(f"t{t}")) for t in "xyz"}
    value = [w[t][0] for t in "xyz"]
    return stencil(spark, d).select("vec_id", rd(_contract(C("taps"), value, 2, 1), 6).alias("value"), rd(_contract(C("taps"), [w["x"][1], value[1], value[2]], 2, 1), 6).alias("gx"))


@query("interp_nearest", f"WITH {STENCIL} SELECT vec_id, round(taps[CAST((floor(tz + 1.5) * 4 + floor(ty + 1.5)) * 4 + floor(tx + 1.5) + 1 AS INT)], 6) + 0.0 AS value FROM stencil")
def interp_nearest(spark, d):
    near = {t: F.floor(C(f"t{t}") + 1.5) for t in "xyz"}
    return stencil(spark, d).select("vec_id", rd(F.element_at("taps", ((near["z"] * 4 + near["y"]) * 4 + near["x"] + 1).cast("int")), 6).alias("value"))


_STATS = "st AS (SELECT vec_id, avg(f) AS mf, avg(g) AS mg, sqrt(sum(f*f)) AS nf, sqrt(sum(g*g)) AS ng FROM samp GROUP BY vec_id), ct AS (SELECT s.*, st.* EXCLUDE vec_id, s.f - mf AS cf, s.g - mg AS cg FROM samp s JOIN st USING (vec_id)), nt AS (SELECT vec_id, sqrt(sum(cf*cf)) AS zf, sqrt(sum(cg*cg)) AS zg FROM ct GROUP BY vec_id), al AS (SELECT ct.*, zf, zg FROM ct JOIN nt USING (vec_id))"
_OBJ = {
    "sad": "sum(abs(g - f))", "ssd": "sum((g - f) * (g - f))", "zssd": "sum((cg - cf) * (cg - cf))",
    "nssd": "0.5 * sum(pow(g / (CASE WHEN ng > 0 THEN ng ELSE 1 END) - f / (CASE WHEN nf > 0 THEN nf ELSE 1 END), 2))",
    "znssd": "0.25 * sum(pow(cg / (CASE WHEN zg > 0 THEN zg ELSE 1 END) - cf / (CASE WHEN zf > 0 THEN zf ELSE 1 END), 2))",
}


def _objective(kind):
    @query(f"objective_{kind}", f"WITH {SUBVOL}, {_STATS} SELECT vec_id, round({_OBJ[kind]}, 6) + 0.0 AS objective FROM al GROUP BY vec_id")
    def run(spark, d):
        return subvol(spark, d).select("vec_id", rd(a.objective(C("f"), C("g"), kind), 6).alias("objective"))


for _k in a.KINDS:
    _objective(_k)


@query("reference_stats", f"WITH {SUBVOL}, {_STATS} SELECT vec_id, round(any_value(mf), 6) + 0.0 AS mean, round(any_value(nf), 6) AS norm, round(any_value(zf), 6) AS centred_norm FROM al GROUP BY vec_id")
def reference_stats(spark, d):
    return subvol(spark, d).select("vec_id", rd(a.mean(C("f")), 6).alias("mean"), rd(a.norm(C("f")), 6).alias("norm"), rd(a.norm(a.centred(C("f"))), 6).alias("centred_norm"))


@query("reference_terms", f"WITH {SUBVOL}, {_STATS} SELECT vec_id, CAST(i - 1 AS INT) AS sample, round(cf / zf, 7) + 0.0 AS q, round(mf, 6) + 0.0 AS shift FROM al")
def reference_terms(spark, d):
    q = a.reference_term(C("f"), "znssd")
    return subvol(spark, d).select("vec_id", F.posexplode(q).alias("sample", "q"), a.mean(C("f")).alias("shift")).select("vec_id", "sample", rd(C("q"), 7).alias("q"), rd(C("shift"), 6).alias("shift"))


_J = ("gx", "gy", "gz")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SUM_SQL = ", ".join(
    [f"sum({_J[i]} * {_J[j]}) AS jj{i}{j}" for i, j in _PAIRS] + [f"sum({x}) AS j{i}" for i, x in enumerate(_J)] + [f"sum((g - mf) * {x}) AS vj{i}" for i, x in enumerate(_J)] + [f"sum(cf / zf * {x}) AS qj{i}" for i, x in enumerate(_J)]
    + ["sum(g - mf) AS v", "sum((g - mf) * (g - mf)) AS vv", "sum((g - mf) * cf / zf) AS vq", "sum(cf / zf) AS q", "sum(cf / zf * cf / zf) AS qq", "CAST(count(*) AS DOUBLE) AS n", "sum(abs(g - mf - cf / zf)) AS absdiff"])
_SUMS = f"sums AS (SELECT vec_id, {_SUM_SQL} FROM al GROUP BY vec_id)"
_NAMES = [f"jj{i}{j}" for i, j in _PAIRS] + [f"j{i}" for i in range(3)] + [f"vj{i}" for i in range(3)] + [f"qj{i}" for i in range(3)] + ["v", "vv", "vq", "q", "qq", "n", "absdiff"]


def gn_sums(df, kind="znssd"):
    """The one-pass sums of a 3-parameter Gauss-Newton step for each row of sample arrays f, g, gx, gy, gz."""
    shift = a.mean(C("f")) if kind in ("zssd", "znssd") else F.lit(0.0)
    df = df.withColumn("q_", a.reference_term(C("f"), kind)).withColumn("s_", shift)
    df = df.withColumn("v_", F.transform("g", lambda x: x - C("s_")))
    j = [C(n) for n in _J]
    cols = [a.dot(j[i], j[k]).alias(f"jj{i}{k}") for i, k in _PAIRS] + [a.total(x).alias(f"j{i}") for i, x in enumerate(j)]
    cols += [a.dot(C("v_"), x).alias(f"vj{i}") for i, x in enumerate(j)] + [a.dot(C("q_"), x).alias(f"qj{i}") for i, x in enumerate(j)]
    v, q = C("v_"), C("q_")
    cols += [a.total(v).alias("v"), a.dot(v, v).alias("vv"), a.dot(v, q).alias("vq"), a.total(q).alias("q"), a.dot(q, q).alias("qq"), F.size("f").cast("double").alias("n"), a.total(F.zip_with(v, q, lambda x, y: F.abs(x - y))).alias("absdiff")]
    return df.select("vec_id", "s_", *cols)


@query("gn_sums", f"WITH {SUBVOL}, {_STATS}, {_SUMS} SELECT vec_id, " + ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in _NAMES) + " FROM sums")
def gn_sums_query(spark, d):
    return gn_sums(subvol(spark, d)).select("vec_id", *[rd(C(n), 5).alias(n) for n in _NAMES])


_NE_SQL = """ne AS (SELECT vec_id, n, vq, qq, v / n AS vb, vv - v * v / n AS n2, """ + ", ".join([f"jj{i}{j} - j{i} * j{j} / n AS c{i}{j}" for i, j in _PAIRS] + [f"vj{i} - v / n * j{i} AS a{i}, qj{i} - j{i} / n * q AS r{i}" for i in range(3)]) + """, q AS sq FROM sums),
na AS (SELECT vec_id, n2, sqrt(n2) AS nm, (vq - vb * sq) / sqrt(n2) AS gq, qq, """ + ", ".join([f"c{i}{j}" for i, j in _PAIRS] + [f"a{i} / sqrt(n2) AS a{i}, r{i}" for i in range(3)]) + """ FROM ne),
nh AS (SELECT vec_id, """ + ", ".join([f"(c{i}{j} - a{i} * a{j}) / n2 AS h{i}{j}" for i, j in _PAIRS] + [f"(a{i} - r{i} - a{i} * (1 - gq)) / nm AS b{i}" for i in range(3)]) + ", 0.25 * (1 - 2 * gq + qq) AS objective FROM na)"


def normal_equations(sums):
    """H, b and the objective of znssd from the sums: centre the Jacobian, take out its part along the target, scale by the norm."""
    n, vbar = C("n"), C("v") / C("n")
    norm2 = C("vv") - C("v") * vbar
    s = sums.select("*", vbar.alias("vbar"), norm2.alias("norm2"), F.sqrt(norm2).alias("norm"))
    s = s.select("*", ((C("vq") - C("vbar") * C("q")) / C("norm")).alias("gq"), *[((C(f"vj{i}") - C("vbar") * C(f"j{i}")) / C("norm")).alias(f"a{i}") for i in range(3)])
    h = [((C(f"jj{i}{j}") - C(f"j{i}") * C(f"j{j}") / n - C(f"a{i}") * C(f"a{j}")) / C("norm2")).alias(f"h{i}{j}") for i, j in _PAIRS]
    b = [((C(f"a{i}") - C(f"qj{i}") + C(f"j{i}") / n * C("q") - C(f"a{i}") * (1 - C("gq"))) / C("norm")).alias(f"b{i}") for i in range(3)]
    return s.select("vec_id", *h, *b, (0.25 * (1 - 2 * C("gq") + C("qq"))).alias("objective"), (C("jj00") + C("jj11") + C("jj22")).alias("grad_energy"), (C("vv") + 2 * C("s_") * C("v") + n * C("s_") * C("s_")).alias("sum_g2"))


_NE = [f"h{i}{j}" for i, j in _PAIRS] + ["b0", "b1", "b2", "objective"]


@query("normal_equations", f"WITH {SUBVOL}, {_STATS}, {_SUMS}, {_NE_SQL} SELECT vec_id, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in _NE) + " FROM nh")
def normal_equations_query(spark, d):
    return normal_equations(gn_sums(subvol(spark, d))).select("vec_id", *[rd(C(n), 6).alias(n) for n in _NE])


def cholesky_step3(ne, tol=1e-10):
    """dp of H dp = -b for 3 unknowns: unit-diagonal scaling, Cholesky with a pivot test, two substitutions."""
    sc = [1 / F.sqrt(F.when(C(f"h{i}{i}") > 0, C(f"h{i}{i}")).otherwise(1.0)) for i in range(3)]
    s = ne.select("*", *[x.alias(f"sc{i}") for i, x in enumerate(sc)])
    s = s.select("*", *[(C(f"h{i}{j}") * C(f"sc{i}") * C(f"sc{j}")).alias(f"m{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))])
    s = s.select("*", (1 - C("m01") * C("m01")).alias("p1")).select("*", F.sqrt(F.when(C("p1") > tol, C("p1")).otherwise(1.0)).alias("d1"))
    s = s.select("*", ((C("m12") - C("m01") * C("m02")) / C("d1")).alias("l21"))
    s = s.select("*", (1 - C("m02") * C("m02") - C("l21") * C("l21")).alias("p2")).select("*", F.sqrt(F.when(C("p2") > tol, C("p2")).otherwise(1.0)).alias("d2"))
    s = s.select("*", (-C("b0") * C("sc0")).alias("y0"))
    s = s.select("*", ((-C("b1") * C("sc1") - C("m01") * C("y0")) / C("d1")).alias("y1"))
    s = s.select("*", ((-C("b2") * C("sc2") - C("m02") * C("y0") - C("l21") * C("y1")) / C("d2") / C("d2")).alias("x2"))
    s = s.select("*", ((C("y1") - C("l21") * C("x2")) / C("d1")).alias("x1"))
    s = s.select("*", (C("y0") - C("m01") * C("x1") - C("m02") * C("x2")).alias("x0"))
    flat = ~(C("grad_energy") > 1e-12 * C("sum_g2"))
    pivots = (C("h00") > 0) & (C("h11") > 0) & (C("h22") > 0) & (C("p1") > tol) & (C("p2") > tol)
    return s.select("vec_id", *[F.when(pivots, C(f"x{i}") * C(f"sc{i}")).otherwise(0.0).alias(f"dp{i}") for i in range(3)], (~pivots | flat).alias("singular"), "objective")


_DET = "h00*(h11*h22-h12*h12) - h01*(h01*h22-h12*h02) + h02*(h01*h12-h11*h02)"


@query("gn_update", f"""WITH {SUBVOL}, {_STATS}, {_SUMS}, {_NE_SQL}, dt AS (SELECT *, {_DET} AS det FROM nh)
SELECT vec_id, round(-((h11*h22-h12*h12)*b0 + (h02*h12-h01*h22)*b1 + (h01*h12-h02*h11)*b2) / det, 5) + 0.0 AS dp0, round(-((h02*h12-h01*h22)*b0 + (h00*h22-h02*h02)*b1 + (h01*h02-h00*h12)*b2) / det, 5) + 0.0 AS dp1, round(-((h01*h12-h02*h11)*b0 + (h01*h02-h00*h12)*b1 + (h00*h11-h01*h01)*b2) / det, 5) + 0.0 AS dp2, false AS singular FROM dt""")
def gn_update(spark, d):
    """One step; the twin inverts H by cofactors instead."""
    step = cholesky_step3(normal_equations(gn_sums(subvol(spark, d))))
    return step.select("vec_id", *[rd(C(f"dp{i}"), 5).alias(f"dp{i}") for i in range(3)], "singular")


@query("threshold_filter", f"WITH {SUBVOL} SELECT vec_id, round(avg(CASE WHEN f BETWEEN -1 AND 1 THEN 1.0 ELSE 0.0 END), 9) AS share, avg(CASE WHEN f BETWEEN -1 AND 1 THEN 1.0 ELSE 0.0 END) < 0.7 AS thresh_fail, NOT (max(f) - min(f) > 1e-12 * max(abs(f))) AS textureless FROM samp GROUP BY vec_id")
def threshold_filter(spark, d):
    share = a.share_between(C("f"), -1.0, 1.0)
    return subvol(spark, d).select("vec_id", rd(share).alias("share"), (share < 0.7).alias("thresh_fail"), a.textureless(C("f")).alias("textureless"))


@query("basin_search", f"""WITH {SUBVOL}, c AS (SELECT vec_id, 0 AS k, sum((g-f)*(g-f)) AS o FROM samp GROUP BY vec_id UNION ALL SELECT vec_id, 1, sum((gx-f)*(gx-f)) FROM samp GROUP BY vec_id UNION ALL SELECT vec_id, 2, sum((gy-f)*(gy-f)) FROM samp GROUP BY vec_id UNION ALL SELECT vec_id, 3, sum((gz-f)*(gz-f)) FROM samp GROUP BY vec_id)
SELECT vec_id, CAST(k AS INT) AS best, round(o, 6) AS objective FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(o, 9), k) = 1""")
def basin_search(spark, d):
    """The candidate with the least objective; the first of equals wins."""
    options = F.array(*[F.struct(F.round(a.objective(C("f"), C(n), "ssd"), 9).alias("o"), F.lit(k).alias("k")) for k, n in enumerate(("g", "gx", "gy", "gz"))])
    return subvol(spark, d).select("vec_id", F.array_min(options).alias("m")).select("vec_id", C("m.k").alias("best"), rd(C("m.o"), 6).alias("objective"))


_KERNEL = {(-1, -1): 1, (-1, 0): -2, (-1, 1): 1, (0, -1): -2, (0, 0): 4, (0, 1): -2, (1, -1): 1, (1, 0): -2, (1, 1): 1}


@query("estimate_noise", """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), q AS (SELECT vec_id, p, i // 8 AS r, i % 8 AS c FROM v),
k(dr, dc, w) AS (VALUES (-1,-1,1),(-1,0,-2),(-1,1,1),(0,-1,-2),(0,0,4),(0,1,-2),(1,-1,1),(1,0,-2),(1,1,1)),
l AS (SELECT q.vec_id, q.r - dr AS r, q.c - dc AS c, sum(p * w) AS lap FROM q, k WHERE q.r - dr BETWEEN 1 AND 6 AND q.c - dc BETWEEN 1 AND 6 GROUP BY ALL),
s AS (SELECT vec_id, sqrt(pi() / 2) * sum(abs(lap)) / 216 AS sigma FROM l GROUP BY vec_id) SELECT round(quantile_cont(sigma, 0.5), 7) AS sigma, CAST(count(*) AS BIGINT) AS slices FROM s""")
def estimate_noise(spark, d):
    """Gaussian noise by the Laplacian of each 8 x 8 slice, median over slices."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    inner = F.array(*[F.lit(r * 8 + c + 1) for r in range(1, 7) for c in range(1, 7)])
    lap = F.transform(inner, lambda p: sum((F.element_at(C("v"), p + dr * 8 + dc) * w for (dr, dc), w in list(_KERNEL.items())[1:]), F.element_at(C("v"), p - 9)))
    sigma = a.total(F.transform(lap, lambda x: F.abs(x))) * math.sqrt(math.pi / 2) / 216
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select(sigma.alias("sigma")).agg(rd(F.percentile("sigma", F.lit(0.5)), 7).alias("sigma"), F.count(F.lit(1)).alias("slices"))


def gaussian_weights(sigma):
    r = math.ceil(4 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


@query("gaussian_prefilter", f"""
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k(o, w) AS (VALUES {", ".join(f"({k - 3}, {w!r}::DOUBLE)" for k, w in enumerate(gaussian_weights(0.7)))}),
t AS (SELECT DISTINCT vec_id, i FROM v) SELECT t.vec_id, CAST(t.i AS INT) AS sample, round(sum(p * w), 6) + 0.0 AS smooth FROM t, k JOIN v ON v.vec_id = t.vec_id AND v.i = least(greatest(t.i + o, 0), 63) GROUP BY ALL""")
def gaussian_prefilter(spark, d):
    """One axis of the separable filter, edges repeated."""
    w = gaussian_weights(0.7)
    taps = lambda i: sum((F.element_at(C("v"), F.least(F.greatest(i + k - 3, F.lit(0)), F.lit(63)) + 1) * x for k, x in enumerate(w[1:], 1)), F.element_at(C("v"), F.greatest(i - 3, F.lit(0)) + 1) * w[0])
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), taps)).alias("sample", "s")).select("vec_id", "sample", rd(C("s"), 6).alias("smooth"))
