"""Accuracy, agreement, repeatability and run statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrvox.functions.geometry import edge_mask
from corrvox.operators import metrics as m
from corrvox.operators.quantiles import quantiles
from corrvox.operators.tables import cut
from corrvox.plans.fixtures import EVLOG, PTS, RESULTS, TRUTH, evlog, pts, rd, res_a, res_b, res_c, table, truth
from corrvox.plans.registry import query

C = F.col
_ERR = "e AS (SELECT a.point_id, a.x, a.y, a.z, a.status AS sa, b.status AS sb, a.objmin AS oa, b.objmin AS ob, a.u - b.u AS eu, a.v - b.v AS ev, a.w - b.w AS ew, b.u AS bu, b.v AS bv, b.w AS bw, a.u AS au, a.v AS av, a.w AS aw, sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v) + (a.w-b.w)*(a.w-b.w)) AS mag FROM res_a a JOIN res_b b USING (point_id))"


def _acc(cond: str) -> str:
    f = f" FILTER (WHERE {cond})"
    return ", ".join([f"round(avg(e{c}){f}, 9) AS bias_{c}" for c in "uvw"] + [f"round(sqrt(avg(e{c} * e{c}){f}), 9) AS rmse_{c}" for c in "uvw"] + [f"round(quantile_cont(mag, {q / 100}){f}, 9) AS p{q}" for q in (50, 95, 99)])


@query("accuracy", f"WITH {RESULTS}, e AS (SELECT a.status AS sa, a.u - t.u AS eu, a.v - t.v AS ev, a.w - t.w AS ew, sqrt((a.u-t.u)*(a.u-t.u) + (a.v-t.v)*(a.v-t.v) + (a.w-t.w)*(a.w-t.w)) AS mag FROM res_a a JOIN truth t USING (point_id)) SELECT count(*) AS n_points, count(*) FILTER (WHERE sa = 0) AS n_good, round(avg(CASE WHEN sa = 0 THEN 1.0 ELSE 0.0 END), 9) AS frac_good, {_acc('sa = 0')} FROM e")
def accuracy(spark, d):
    return m.accuracy(res_a(spark, d), truth(pts(spark, d)).select("point_id", "u", "v", "w"))


@query("exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.0), 9) AS p0, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.999), 9) AS p999, round(quantile_cont(value, 1.0), 9) AS p100 FROM events GROUP BY event_type")
def exact_quantiles(spark, d):
    """Quantiles by selection; at most 50 values are ever sorted."""
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    return quantiles(table(spark, d, "events"), ["event_type"], "value", shares, cut, few=50, width=64).select("event_type", *[F.round(p, 9).alias(p) for p in shares])


@query("match_ids", f"WITH {RESULTS} SELECT a.point_id, a.status AS a_status, b.status AS b_status FROM res_a a JOIN res_b b USING (point_id) WHERE a.status = 0")
def match_ids(spark, d):
    return m.match(res_a(spark, d).where("status = 0"), res_b(spark, d)).select("point_id", "a_status", "b_status")


@query("three_way_match", f"WITH {RESULTS} SELECT a.point_id, round(a.u - b.u, 9) + 0.0 AS d_u, round(a.u - c.u, 9) + 0.0 AS e_u FROM res_a a JOIN res_b b USING (point_id) JOIN res_c c USING (point_id) WHERE a.status = 0 AND b.status = 0 AND c.status = 0")
def three_way_match(spark, d):
    good = [f(spark, d).where("status = 0").select("point_id", C("u").alias(n)) for f, n in ((res_a, "ua"), (res_b, "ub"), (res_c, "uc"))]
    return good[0].join(good[1], "point_id").join(good[2], "point_id").select("point_id", rd(C("ua") - C("ub")).alias("d_u"), rd(C("ua") - C("uc")).alias("e_u"))


@query("completeness", f"WITH {RESULTS} SELECT t.point_id FROM truth t ANTI JOIN (SELECT point_id FROM res_b WHERE status > -3) r USING (point_id)")
def completeness(spark, d):
    return m.missing(res_b(spark, d).where("status > -3"), truth(pts(spark, d))).select("point_id")


@query("status_counts", f"WITH {RESULTS} SELECT status, count(*) AS points FROM res_b GROUP BY status")
def status_counts(spark, d):
    return res_b(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("points"))


@query("status_confusion", f"WITH {RESULTS} SELECT concat(greatest(a.status, -3), '/', b.status) AS pair, count(*) AS points FROM res_a a JOIN res_b b USING (point_id) GROUP BY ALL")
def status_confusion(spark, d):
    pair = F.concat_ws("/", m.to_ccpi(C("a_status")).cast("string"), C("b_status").cast("string"))
    return m.match(res_a(spark, d), res_b(spark, d)).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("points"))


_EDGE = "(x - 6 < 0 OR x + 6 > 159 OR y - 6 < 0 OR y + 6 > 159 OR z - 6 < 0 OR z + 6 > 199 OR x + bu - 6 < 0 OR x + bu + 6 > 159 OR y + bv - 6 < 0 OR y + bv + 6 > 159 OR z + bw - 6 < 0 OR z + bw + 6 > 199)"
_AGREE = f"count(*) AS n_points, count(*) FILTER (WHERE sa = 0 AND sb = 0) AS n_good_both, round(avg(CASE WHEN greatest(sa, -3) = sb THEN 1.0 ELSE 0.0 END), 9) AS status_agreement, {_acc('sa = 0 AND sb = 0')}"


@query("agreement", f"WITH {RESULTS}, {_ERR}, k AS (SELECT *, {_EDGE} AS edge FROM e) SELECT 'all' AS part, {_AGREE} FROM k UNION ALL SELECT CASE WHEN edge THEN 'edge' ELSE 'interior' END, {_AGREE} FROM k GROUP BY edge")
def agreement(spark, d):
    edge = edge_mask((C("b_x"), C("b_y"), C("b_z")), (C("b_u"), C("b_v"), C("b_w")), (160, 160, 200), 6.0)
    return m.agreement(res_a(spark, d), res_b(spark, d), edge)


@query("q1_pass", f"WITH {RESULTS}, {_ERR} SELECT quantile_cont(mag, 0.5) FILTER (WHERE sa = 0 AND sb = 0) <= 0.05 AND quantile_cont(mag, 0.95) FILTER (WHERE sa = 0 AND sb = 0) <= 0.2 AND avg(CASE WHEN greatest(sa, -3) = sb THEN 1.0 ELSE 0.0 END) >= 0.98 AS q1_pass FROM e WHERE NOT {_EDGE}")
def q1_pass(spark, d):
    a = agreement(spark, d).where("part = 'interior'")
    return a.select(((C("p50") <= 0.05) & (C("p95") <= 0.2) & (C("status_agreement") >= 0.98)).alias("q1_pass"))


@query("revised_q1", f"""WITH {RESULTS}, g AS (SELECT a.u - b.u AS du, a.v - b.v AS dv, a.w - b.w AS dw, a.u - c.u AS cu, a.v - c.v AS cv, a.w - c.w AS cw FROM res_a a JOIN res_b b USING (point_id) JOIN res_c c USING (point_id) WHERE a.status = 0 AND b.status = 0 AND c.status = 0)
SELECT count(*) AS n_points, round(avg(du), 9) AS mean_u, round(avg(dv), 9) AS mean_v, round(avg(dw), 9) AS mean_w, round(stddev_pop(du) / greatest(stddev_pop(cu), 1e-12), 7) AS ratio_u, round(stddev_pop(dv) / greatest(stddev_pop(cv), 1e-12), 7) AS ratio_v, round(stddev_pop(dw) / greatest(stddev_pop(cw), 1e-12), 7) AS ratio_w,
 greatest(abs(avg(du)), abs(avg(dv)), abs(avg(dw))) <= 0.01 AND greatest(stddev_pop(du) / greatest(stddev_pop(cu), 1e-12), stddev_pop(dv) / greatest(stddev_pop(cv), 1e-12), stddev_pop(dw) / greatest(stddev_pop(cw), 1e-12)) <= 1.25 AS pass FROM g""")
def revised_q1(spark, d):
    """No bias, and a spread against the other code no larger than 1.25 times the own repeatability (population spreads)."""
    r = {n: f(spark, d).where("status = 0").select("point_id", *[C(c).alias(f"{n}_{c}") for c in "uvw"]) for n, f in (("a", res_a), ("b", res_b), ("c", res_c))}
    j = r["a"].join(r["b"], "point_id").join(r["c"], "point_id")
    mean = {c: F.avg(C(f"a_{c}") - C(f"b_{c}")) for c in "uvw"}
    ratio = {c: F.stddev_pop(C(f"a_{c}") - C(f"b_{c}")) / F.greatest(F.stddev_pop(C(f"a_{c}") - C(f"c_{c}")), F.lit(1e-12)) for c in "uvw"}
    ok = (F.greatest(*[F.abs(x) for x in mean.values()]) <= 0.01) & (F.greatest(*ratio.values()) <= 1.25)
    return j.agg(F.count(F.lit(1)).alias("n_points"), *[F.round(x, 9).alias(f"mean_{c}") for c, x in mean.items()], *[F.round(x, 7).alias(f"ratio_{c}") for c, x in ratio.items()], ok.alias("pass"))


@query("compare_pair", f"""WITH {RESULTS}, {_ERR}, k AS (SELECT *, ({_EDGE} OR {_EDGE.replace('bu', 'au').replace('bv', 'av').replace('bw', 'aw')}) AS edge, (round_even(au, 6) = round_even(bu, 6) AND round_even(av, 6) = round_even(bv, 6) AND round_even(aw, 6) = round_even(bw, 6)) AS same6 FROM e)
SELECT count(*) AS points, count(*) FILTER (WHERE edge) AS edge_points, round(avg(CASE WHEN greatest(sa, -3) = sb THEN 1.0 ELSE 0.0 END), 9) AS status_agreement_all, count(*) FILTER (WHERE sa = 0 AND sb = 0 AND NOT edge) AS compared, count(*) FILTER (WHERE same6 AND sa = 0 AND sb = 0 AND NOT edge) AS identical_6dp, round(max(mag) FILTER (WHERE sa = 0 AND sb = 0 AND NOT edge), 9) AS max_mag,
 round(max(abs(eu)) FILTER (WHERE sa = 0 AND sb = 0 AND NOT edge), 9) AS max_abs_u, round(quantile_cont(abs(oa - ob) / greatest(abs(ob), 1e-12), 0.5) FILTER (WHERE sa = 0 AND sb = 0 AND NOT edge), 7) AS objmin_rel_median FROM k""")
def compare_pair(spark, d):
    k = m.with_error(m.match(res_a(spark, d), res_b(spark, d)))
    edge = F.lit(False)
    for r in ("a", "b"):
        edge = edge | edge_mask((C("a_x"), C("a_y"), C("a_z")), tuple(C(f"{r}_{c}") for c in "uvw"), (160, 160, 200), 6.0)
    same = F.lit(True)
    for c in "uvw":
        same = same & (F.bround(C(f"a_{c}"), 6) == F.bround(C(f"b_{c}"), 6))
    k = k.withColumn("edge", edge).withColumn("same6", same)
    good = (C("a_status") == 0) & (C("b_status") == 0) & ~C("edge")
    rel = F.abs(C("a_objmin") - C("b_objmin")) / F.greatest(F.abs("b_objmin"), F.lit(1e-12))
    return k.agg(
        F.count(F.lit(1)).alias("points"), F.count(F.when(C("edge"), 1)).alias("edge_points"), F.round(F.avg((m.to_ccpi(C("a_status")) == C("b_status")).cast("double")), 9).alias("status_agreement_all"),
        F.count(F.when(good, 1)).alias("compared"), F.count(F.when(good & C("same6"), 1)).alias("identical_6dp"), F.round(F.max(F.when(good, C("mag"))), 9).alias("max_mag"),
        F.round(F.max(F.when(good, F.abs("eu"))), 9).alias("max_abs_u"), F.round(F.percentile(F.when(good, rel), F.lit(0.5)), 7).alias("objmin_rel_median"))


@query("error_stats", f"WITH {RESULTS}, e AS (SELECT a.status AS s, a.u - t.u AS eu, a.v - t.v AS ev, a.w - t.w AS ew, a.point_id % 9 AS it FROM res_a a JOIN truth t USING (point_id)) SELECT count(*) AS n_points, round(avg(CASE WHEN s = 0 THEN 1.0 ELSE 0.0 END), 9) AS frac_good, " + ", ".join(f"round(avg(e{c}) FILTER (WHERE s = 0), 9) AS bias_{c}, round(stddev_samp(e{c}) FILTER (WHERE s = 0), 9) AS std_{c}" for c in "uvw") + ", round(sqrt(avg(eu*eu + ev*ev + ew*ew) FILTER (WHERE s = 0)), 9) AS rmse, round(avg(it) FILTER (WHERE s = 0), 9) AS mean_iter FROM e")
def error_stats(spark, d):
    """Sample spread by axis, rmse of the error vector and mean iterations of the GOOD points."""
    k = m.with_error(m.match(res_a(spark, d), truth(pts(spark, d)).select("point_id", "u", "v", "w")))
    good = C("a_status") == 0
    cols = [x for c in "uvw" for x in (F.round(F.avg(F.when(good, C(f"e{c}"))), 9).alias(f"bias_{c}"), F.round(F.stddev_samp(F.when(good, C(f"e{c}"))), 9).alias(f"std_{c}"))]
    return k.agg(F.count(F.lit(1)).alias("n_points"), F.round(F.avg(good.cast("double")), 9).alias("frac_good"), *cols, F.round(F.sqrt(F.avg(F.when(good, C("mag") * C("mag")))), 9).alias("rmse"), F.round(F.avg(F.when(good, C("point_id") % 9)), 9).alias("mean_iter"))


def _runs(spark, d):
    """Three runs that differ in their template seed, stacked."""
    out = None
    for k, f in enumerate((res_a, res_b, res_c)):
        r = f(spark, d).select(F.lit(k).alias("seed"), "point_id", "status", "u", "v", "w")
        out = r if out is None else out.unionByName(r)
    return out


_RUNS = "runs AS (SELECT 0 AS seed, point_id, status, u, v, w FROM res_a UNION ALL SELECT 1, point_id, status, u, v, w FROM res_b UNION ALL SELECT 2, point_id, status, u, v, w FROM res_c)"


@query("seed_repeatability", f"""WITH {RESULTS}, {_RUNS}, p AS (SELECT a.seed AS sa, b.seed AS sb, a.u - b.u AS eu, a.v - b.v AS ev, a.w - b.w AS ew, sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v) + (a.w-b.w)*(a.w-b.w)) AS mag FROM runs a JOIN runs b ON a.point_id = b.point_id AND a.seed < b.seed WHERE a.status = 0 AND b.status = 0)
SELECT sa, sb, count(*) AS n_good_both, round(avg(eu), 9) AS mean_u, round((stddev_samp(eu) + stddev_samp(ev) + stddev_samp(ew)) / 3, 9) AS mean_std, round(quantile_cont(mag, 0.5), 9) AS median_abs, round(quantile_cont(mag, 0.95), 9) AS p95_abs FROM p GROUP BY sa, sb""")
def seed_repeatability(spark, d):
    p = _seed_pairs(spark, d)
    return p.groupBy("sa", "sb").agg(F.count(F.lit(1)).alias("n_good_both"), F.round(F.avg("eu"), 9).alias("mean_u"), F.round((F.stddev_samp("eu") + F.stddev_samp("ev") + F.stddev_samp("ew")) / 3, 9).alias("mean_std"), F.round(F.percentile("mag", F.lit(0.5)), 9).alias("median_abs"), F.round(F.percentile("mag", F.lit(0.95)), 9).alias("p95_abs"))


def _seed_pairs(spark, d):
    a = _runs(spark, d).where("status = 0")
    p = a.select("point_id", C("seed").alias("sa"), *[C(c).alias(f"a_{c}") for c in "uvw"]).join(a.select("point_id", C("seed").alias("sb"), *[C(c).alias(f"b_{c}") for c in "uvw"]), "point_id").where("sa < sb")
    return m.with_error(p)


@query("per_estimate_std", f"""WITH {RESULTS}, {_RUNS}, p AS (SELECT a.seed AS sa, b.seed AS sb, stddev_samp(a.u - b.u) AS su, stddev_samp(a.v - b.v) AS sv, stddev_samp(a.w - b.w) AS sw FROM runs a JOIN runs b ON a.point_id = b.point_id AND a.seed < b.seed WHERE a.status = 0 AND b.status = 0 GROUP BY ALL)
SELECT round(avg((su + sv + sw) / 3) / sqrt(2), 8) AS per_estimate_std FROM p""")
def per_estimate_std(spark, d):
    return _seed_pairs(spark, d).groupBy("sa", "sb").agg(((F.stddev_samp("eu") + F.stddev_samp("ev") + F.stddev_samp("ew")) / 3).alias("s")).agg(F.round(F.avg("s") / F.sqrt(F.lit(2.0)), 8).alias("per_estimate_std"))


@query("seed_spread", f"WITH {RESULTS}, {_RUNS} SELECT point_id, count(*) FILTER (WHERE status = 0) AS n_good, " + ", ".join(f"round(stddev_samp({c}) FILTER (WHERE status = 0), 9) AS sd_{c}" for c in "uvw") + " FROM runs GROUP BY point_id")
def seed_spread(spark, d):
    """Sample spread of each point's GOOD estimates over the runs; null with fewer than two."""
    good = C("status") == 0
    n = F.count(F.when(good, 1))
    return _runs(spark, d).groupBy("point_id").agg(n.alias("n_good"), *[F.when(n > 1, F.round(F.stddev_samp(F.when(good, C(c))), 9)).alias(f"sd_{c}") for c in "uvw"])


@query("own_right_wrong", f"WITH {RESULTS}, e AS (SELECT a.status AS s, a.point_id % 8 AS grp, sqrt((a.u-t.u)*(a.u-t.u) + (a.v-t.v)*(a.v-t.v) + (a.w-t.w)*(a.w-t.w)) AS mag, a.u - t.u AS eu FROM res_a a JOIN truth t USING (point_id)) SELECT grp, count(*) FILTER (WHERE s = 0) AS good, count(*) FILTER (WHERE s = 0 AND mag <= 0.03) AS right_points, count(*) FILTER (WHERE s = 0 AND mag > 0.03) AS good_but_wrong, round(stddev_pop(eu) FILTER (WHERE s = 0 AND mag <= 0.03), 9) AS right_sd_u FROM e GROUP BY grp")
def own_right_wrong(spark, d):
    k = m.with_error(m.match(res_a(spark, d), truth(pts(spark, d)).select("point_id", "u", "v", "w")))
    good, right = C("a_status") == 0, C("mag") <= 0.03
    return k.groupBy((C("point_id") % 8).alias("grp")).agg(F.count(F.when(good, 1)).alias("good"), F.count(F.when(good & right, 1)).alias("right_points"), F.count(F.when(good & ~right, 1)).alias("good_but_wrong"), F.round(F.stddev_pop(F.when(good & right, C("eu"))), 9).alias("right_sd_u"))


@query("case_stats", f"WITH {RESULTS}, {_ERR} SELECT point_id % 27 AS case_id, count(*) AS n, round(avg(eu), 9) AS mean_u, round(stddev_pop(eu), 9) AS sd_u, round(sqrt(avg(eu*eu)), 9) AS rmse_u, round(quantile_cont(mag, 0.5), 9) AS median_abs, round(quantile_cont(mag, 0.95), 9) AS p95_abs, round(avg(CASE WHEN (sa = 0) = (sb = 0) THEN 1.0 ELSE 0.0 END), 9) AS status_agreement FROM e GROUP BY ALL")
def case_stats(spark, d):
    k = m.with_error(m.match(res_a(spark, d), res_b(spark, d)))
    return k.groupBy((C("point_id") % 27).alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("eu"), 9).alias("mean_u"), F.round(F.stddev_pop("eu"), 9).alias("sd_u"), F.round(F.sqrt(F.avg(C("eu") * C("eu"))), 9).alias("rmse_u"), F.round(F.percentile("mag", F.lit(0.5)), 9).alias("median_abs"), F.round(F.percentile("mag", F.lit(0.95)), 9).alias("p95_abs"), F.round(F.avg(((C("a_status") == 0) == (C("b_status") == 0)).cast("double")), 9).alias("status_agreement"))


@query("affine_fit", f"WITH {PTS} SELECT 'u' AS component, 1.25::DOUBLE AS t, 0.0156::DOUBLE AS gx, -0.0078 AS gy, 0.0::DOUBLE AS gz UNION ALL SELECT 'v', -0.5, 0.0, 0.0, 0.0039 UNION ALL SELECT 'w', 0.25, 0.002, 0.002, 0.0")
def affine_fit(spark, d):
    """Least squares u = t + G x: sums of products in one pass, a 4 x 4 solve on one row."""
    t = truth(pts(spark, d))
    basis = [F.lit(1.0), C("x") - 80, C("y") - 80, C("z") - 100]
    aggs = [F.sum(basis[i] * basis[j]).alias(f"a{i}{j}") for i in range(4) for j in range(4)] + [F.sum(basis[i] * C(c)).alias(f"b{i}{c}") for i in range(4) for c in "uvw"]

    def solve(batches):
        import numpy as np
        import pandas as pd

        for p in batches:
            for r in p.to_dict("records"):
                a = np.array([[r[f"a{i}{j}"] for j in range(4)] for i in range(4)])
                out = []
                for c in "uvw":
                    k = np.linalg.lstsq(a, np.array([r[f"b{i}{c}"] for i in range(4)]), rcond=None)[0]
                    k[0] -= k[1] * 80 + k[2] * 80 + k[3] * 100
                    out.append((c, *(round(float(v), 4) + 0.0 for v in k)))
                yield pd.DataFrame(out, columns=["component", "t", "gx", "gy", "gz"])

    return t.agg(*aggs).mapInPandas(solve, "component string, t double, gx double, gy double, gz double")


@query("error_floor_summary", "WITH c AS (SELECT event_id % 6 + 1 AS noise, user_id % 3 AS size, abs(value) / 100 + (event_id % 6 + 1) * 0.01::DOUBLE AS sd FROM events), g AS (SELECT size, noise, avg(sd) AS sd FROM c GROUP BY ALL) SELECT size, round(regr_slope(ln(sd), ln(noise)), 7) + 0.0 AS slope, round(max(sd), 9) AS worst FROM g GROUP BY size")
def error_floor_summary(spark, d):
    """Log-log slope of the random error against the noise, by subvolume size."""
    c = table(spark, d, "events").select((C("event_id") % 6 + 1).alias("noise"), (C("user_id") % 3).alias("size"), (F.abs("value") / 100 + (C("event_id") % 6 + 1) * 0.01).alias("sd"))
    g = c.groupBy("size", "noise").agg(F.avg("sd").alias("sd"))
    return g.groupBy("size").agg(rd(F.regr_slope(F.log("sd"), F.log(C("noise").cast("double"))), 7).alias("slope"), F.round(F.max("sd"), 9).alias("worst"))


@query("error_pivot", "WITH c AS (SELECT event_id % 4 AS size, event_id % 3 AS samples, value FROM events) SELECT size, round(avg(value) FILTER (WHERE samples = 0), 9) AS m0, round(avg(value) FILTER (WHERE samples = 1), 9) AS m1, round(avg(value) FILTER (WHERE samples = 2), 9) AS m2 FROM c GROUP BY size")
def error_pivot(spark, d):
    c = table(spark, d, "events").select((C("event_id") % 4).alias("size"), (C("event_id") % 3).cast("int").alias("samples"), "value")
    p = c.groupBy("size").pivot("samples", [0, 1, 2]).agg(F.round(F.avg("value"), 9))
    return p.select("size", *[C(str(k)).alias(f"m{k}") for k in range(3)])


_T = ["solve", "read", "write", "wait_read", "wait_write"]


@query("timeline", f"""WITH {EVLOG}, w AS (SELECT worker, min(t0) AS b, max(t1) AS f, max(t1) FILTER (WHERE ev = 'solve') AS last_solve, count(*) FILTER (WHERE ev = 'solve') AS tiles, CAST(coalesce(sum(points) FILTER (WHERE ev = 'solve'), 0) AS BIGINT) AS points, CAST(coalesce(sum(bytes) FILTER (WHERE ev = 'read'), 0) AS BIGINT) AS bytes_read, {", ".join(f"coalesce(sum(t1 - t0) FILTER (WHERE ev = '{t}'), 0) AS {t}_s" for t in _T)} FROM evlog GROUP BY worker)
SELECT worker, tiles, points, bytes_read, {", ".join(f"round({t}_s, 4) AS {t}_s" for t in _T)}, round(f - b, 4) AS wall_s, round(solve_s / (f - b), 9) AS utilisation, round(greatest(max(f) OVER () - coalesce(last_solve, b), 0), 4) AS tail_idle_s FROM w""")
def timeline(spark, d):
    return timeline_of(evlog(spark, d))


def timeline_of(log):
    """Per worker: wall time, time by kind, utilisation, idle tail and bytes."""
    is_ = {t: C("ev") == t for t in _T}
    sums = [F.coalesce(F.sum(F.when(is_[t], C("t1") - C("t0"))), F.lit(0.0)).alias(f"{t}_s") for t in _T]
    w = log.groupBy("worker").agg(F.min("t0").alias("b"), F.max("t1").alias("f"), F.max(F.when(is_["solve"], C("t1"))).alias("last"), F.count(F.when(is_["solve"], 1)).alias("tiles"), F.coalesce(F.sum(F.when(is_["solve"], C("points"))), F.lit(0)).cast("long").alias("points"), F.coalesce(F.sum(F.when(is_["read"], C("bytes"))), F.lit(0)).cast("long").alias("bytes_read"), *sums)
    end = w.agg(F.max("f").alias("end"))  # one row
    w = w.join(F.broadcast(end))
    return w.select("worker", "tiles", "points", "bytes_read", *[F.round(f"{t}_s", 4).alias(f"{t}_s") for t in _T], F.round(C("f") - C("b"), 4).alias("wall_s"), F.round(C("solve_s") / (C("f") - C("b")), 9).alias("utilisation"), F.round(F.greatest(C("end") - F.coalesce("last", "b"), F.lit(0.0)), 4).alias("tail_idle_s"))


@query("timeline_summary", f"""WITH {EVLOG}, s AS (SELECT worker, sum(t1 - t0) AS solve_s FROM evlog WHERE ev = 'solve' GROUP BY worker), k AS (SELECT t1 - t0 AS dt FROM evlog WHERE ev = 'solve')
SELECT (SELECT round(max(t1) - min(t0), 4) FROM evlog) AS makespan_s, (SELECT round(max(solve_s) / avg(solve_s), 6) FROM s) AS load_imbalance, round(quantile_cont(dt, 0.5), 4) AS tile_median_s, round(quantile_cont(dt, 0.9), 4) AS tile_p90_s, round(max(dt), 4) AS tile_max_s, count(*) AS tiles FROM k""")
def timeline_summary(spark, d):
    log = evlog(spark, d)
    solve = C("ev") == "solve"
    dt = F.when(solve, C("t1") - C("t0"))
    one = log.agg(F.round(F.max("t1") - F.min("t0"), 4).alias("makespan_s"), F.round(F.percentile(dt, F.lit(0.5)), 4).alias("tile_median_s"), F.round(F.percentile(dt, F.lit(0.9)), 4).alias("tile_p90_s"), F.round(F.max(dt), 4).alias("tile_max_s"), F.count(dt).alias("tiles"))
    load = log.where(solve).groupBy("worker").agg(F.sum(C("t1") - C("t0")).alias("s")).agg(F.round(F.max("s") / F.avg("s"), 6).alias("load_imbalance"))
    return one.join(F.broadcast(load)).select("makespan_s", "load_imbalance", "tile_median_s", "tile_p90_s", "tile_max_s", "tiles")


@query("telemetry", "WITH t AS (SELECT user_id % 4 AS gpu, CASE WHEN event_id % 13 = 0 THEN '[N/A]' ELSE CAST(event_id % 101 AS VARCHAR) END AS util, CAST(event_id % 4096 AS VARCHAR) AS mem FROM events), n AS (SELECT gpu, try_cast(util AS DOUBLE) AS util, try_cast(mem AS DOUBLE) AS mem FROM t) SELECT gpu, count(*) AS samples, round(avg(util), 9) AS util_mean, max(mem) AS mem_max FROM n WHERE util IS NOT NULL AND mem IS NOT NULL GROUP BY gpu")
def telemetry(spark, d):
    """Mean and peak by device; rows with a field that isn't a number are skipped."""
    e = C("event_id")
    t = table(spark, d, "events").select((C("user_id") % 4).alias("gpu"), F.when(e % 13 == 0, "[N/A]").otherwise((e % 101).cast("string")).alias("util"), (e % 4096).cast("string").alias("mem"))
    t = t.select("gpu", F.expr("try_cast(util AS DOUBLE)").alias("util"), F.expr("try_cast(mem AS DOUBLE)").alias("mem")).where("util is not null and mem is not null")
    return t.groupBy("gpu").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("util"), 9).alias("util_mean"), F.max("mem").alias("mem_max"))


@query("scaling_efficiency", "WITH t AS (SELECT CAST(user_id % 8 + 1 AS INT) AS devices, sum(value) AS total FROM events GROUP BY ALL), r AS (SELECT devices, total / devices AS seconds FROM t), k AS (SELECT *, first_value(seconds) OVER (ORDER BY devices) AS s1, first_value(devices) OVER (ORDER BY devices) AS d1 FROM r) SELECT devices, round(s1 * d1 / (devices * seconds), 9) AS strong, round(s1 / seconds, 9) AS weak, round(seconds / max(seconds) OVER (), 9) AS relative FROM k")
def scaling_efficiency(spark, d):
    r = table(spark, d, "events").groupBy((C("user_id") % 8 + 1).cast("int").alias("devices")).agg((F.sum("value")).alias("total")).select("devices", (C("total") / C("devices")).alias("seconds"))
    first = r.agg(F.min(F.struct("devices", "seconds")).alias("one"), F.max("seconds").alias("most"))
    r = r.join(F.broadcast(first))
    return r.select("devices", F.round(C("one.seconds") * C("one.devices") / (C("devices") * C("seconds")), 9).alias("strong"), F.round(C("one.seconds") / C("seconds"), 9).alias("weak"), F.round(C("seconds") / C("most"), 9).alias("relative"))


@query("density_fit", "SELECT 2.0::DOUBLE AS t0, 0.25::DOUBLE AS tau, 0.0::DOUBLE AS c")
def density_fit(spark, d):
    """t = t0 + tau S + c N by non-negative least squares of the relative error: Gram sums, then all 8 active sets."""
    n = (C("p_partkey") % 50 + 1).cast("double")
    s = F.sqrt(n) * 3
    t = 2.0 + 0.25 * s
    rows = [F.lit(1.0) / t, s / t, n / t]
    sums = [F.sum(rows[i] * rows[j]).alias(f"g{i}{j}") for i in range(3) for j in range(3)] + [F.sum(rows[i]).alias(f"b{i}") for i in range(3)]

    def solve(batches):
        import itertools

        import numpy as np
        import pandas as pd

        for p in batches:
            for r in p.to_dict("records"):
                g, b = np.array([[r[f"g{i}{j}"] for j in range(3)] for i in range(3)]), np.array([r[f"b{i}"] for i in range(3)])
                best = (0.0, np.zeros(3))
                for keep in itertools.chain.from_iterable(itertools.combinations(range(3), k) for k in (1, 2, 3)):
                    x = np.zeros(3)
                    x[list(keep)] = np.linalg.lstsq(g[np.ix_(keep, keep)], b[list(keep)], rcond=None)[0]
                    loss = x @ g @ x - 2 * b @ x
                    if (x >= -1e-7).all() and loss < best[0] - 1e-12:
                        best = (loss, np.maximum(x, 0))
                yield pd.DataFrame([tuple(round(float(v), 5) + 0.0 for v in best[1])], columns=["t0", "tau", "c"])

    return table(spark, d, "part").agg(*sums).mapInPandas(solve, "t0 double, tau double, c double")


@query("baseline_join", "WITH cur AS (SELECT concat('m', user_id % 40, CASE WHEN user_id % 2 = 0 THEN '.seconds' ELSE '_us' END) AS name, avg(value) AS v FROM events GROUP BY ALL), base AS (SELECT concat('m', user_id % 40, CASE WHEN user_id % 2 = 0 THEN '.seconds' ELSE '_us' END) AS name, avg(value) * 0.95::DOUBLE AS b FROM events WHERE user_id % 5 <> 0 GROUP BY ALL) SELECT name, CASE WHEN b IS NULL THEN 'skip' WHEN v / b - 1 > (CASE WHEN name LIKE '%.seconds' THEN 0.25 ELSE 0.2 END) THEN 'fail' WHEN v / b - 1 > (CASE WHEN name LIKE '%.seconds' THEN 0.1 ELSE 0.05 END) THEN 'warn' WHEN v / b - 1 < -0.1 THEN 'note' ELSE 'pass' END AS status FROM cur LEFT JOIN base USING (name)")
def baseline_join(spark, d):
    """Each metric against its baseline with warn and fail bands by group."""
    e = table(spark, d, "events")
    name = F.concat(F.lit("m"), (C("user_id") % 40).cast("string"), F.when(C("user_id") % 2 == 0, ".seconds").otherwise("_us"))
    cur = e.groupBy(name.alias("name")).agg(F.avg("value").alias("v"))
    base = e.where("user_id % 5 <> 0").groupBy(name.alias("name")).agg((F.avg("value") * 0.95).alias("b"))
    whole = C("name").endswith(".seconds")
    change = C("v") / C("b") - 1
    status = F.when(C("b").isNull(), "skip").when(change > F.when(whole, 0.25).otherwise(0.2), "fail").when(change > F.when(whole, 0.1).otherwise(0.05), "warn").when(change < -0.1, "note").otherwise("pass")
    return cur.join(base, "name", "left").select("name", status.alias("status"))


@query("baseline_arrays", f"WITH {RESULTS}, {_ERR} SELECT round(avg(CASE WHEN sa = sb THEN 1.0 ELSE 0.0 END), 9) AS status_agreement, round(coalesce(max(greatest(abs(eu), abs(ev), abs(ew))) FILTER (WHERE sa = 0 AND sb = 0), 0), 9) AS max_abs_du FROM e")
def baseline_arrays(spark, d):
    k = m.with_error(m.match(res_a(spark, d), res_b(spark, d)))
    big = F.when((C("a_status") == 0) & (C("b_status") == 0), F.greatest(*[F.abs(f"e{c}") for c in "uvw"]))
    return k.agg(F.round(F.avg((C("a_status") == C("b_status")).cast("double")), 9).alias("status_agreement"), F.round(F.coalesce(F.max(big), F.lit(0.0)), 9).alias("max_abs_du"))


@query("bitwise_findings", "WITH h AS (SELECT event_id, sha256(props) AS now, sha256(CASE WHEN event_id % 10 = 0 THEN concat(props, ' ') ELSE props END) AS was, event_id % 3 AS hw FROM events) SELECT event_id, CASE WHEN now = was THEN 'pass' WHEN hw = 0 THEN 'warn' ELSE 'note' END AS finding FROM h")
def bitwise_findings(spark, d):
    now = F.sha2("props", 256)
    was = F.sha2(F.when(C("event_id") % 10 == 0, F.concat("props", F.lit(" "))).otherwise(C("props")), 256)
    return table(spark, d, "events").select("event_id", F.when(now == was, "pass").when(C("event_id") % 3 == 0, "warn").otherwise("note").alias("finding"))


@query("thread_counts", "SELECT p_partkey, c AS threads FROM part, (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS c) WHERE c < p_size UNION ALL SELECT p_partkey, CAST(p_size AS INT) FROM part")
def thread_counts(spark, d):
    """Powers of two below the number of cores, and the number itself."""
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(7)]), lambda c: c < C("p_size"))
    return table(spark, d, "part").select("p_partkey", F.explode(F.concat(powers, F.array(C("p_size").cast("int")))).alias("threads"))
