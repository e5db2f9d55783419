"""Lattices, default fields, studies, store checks and the formats of other programs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corrvox.config import RunConfig, build
from corrvox.functions import arrays, fields_numpy
from corrvox.functions.kernels import sphere_offsets
from corrvox.operators import strain, studies
from corrvox.operators.metrics import match, with_error
from corrvox.operators.tables import cut, shuffles
from corrvox.plans import cases
from corrvox.plans.fixtures import PTS, RESULTS, STENCIL, SUBVOL, pts, rd, res_a, res_b, res_c, stencil, subvol, table, truth
from corrvox.plans.queries_metrics import _EDGE
from corrvox.plans.queries_samples import _W
from corrvox.plans.queries_volumes import BRICK, NX, NY, VOX, vox
from corrvox.plans.registry import query
from corrvox.sources import text
from corrvox.sources.volumes import bricks_of_voxels, voxel_rows

C = F.col


@query("lekien_marsden", f"WITH {STENCIL}, {_W} SELECT vec_id, round(sum(v * wx[ix] * wy[iy] * wz[iz]), 6) + 0.0 AS value FROM s GROUP BY vec_id")
def lekien_marsden(spark, d):
    """The 64-coefficient tricubic equals the separable weights."""

    def run(batches):
        for b in batches:
            taps = np.stack(b.column("taps").to_numpy(zero_copy_only=False)).reshape(-1, 4, 4, 4)
            t = np.stack([b.column(f"t{a}").to_numpy() for a in "xyz"], 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(fields_numpy.hermite_tricubic(taps, t))], names=["vec_id", "value"])

    s = stencil(spark, d).select("vec_id", "taps", *[C(f"t{a}").cast("double").alias(f"t{a}") for a in "xyz"])
    return s.mapInArrow(run, "vec_id long, value double").select("vec_id", rd(C("value"), 6).alias("value"))


_G = "(1.5::DOUBLE / 79.5)"


def _default(kind, sql):
    @query(f"default_field_{kind}", f"WITH {PTS}, c AS (SELECT *, x - 79.5 AS dx, y - 79.5 AS dy, z - 99.5 AS dz FROM pts) {sql}")
    def run(spark, d):
        field = fields_numpy.default_field(kind, (160, 160, 200))

        def at(batches):
            for b in batches:
                u = field.at(b[["x", "y", "z"]].to_numpy())
                yield b[["point_id"]].assign(u=u[:, 0], v=u[:, 1], w=u[:, 2])

        return pts(spark, d).mapInPandas(at, "point_id long, u double, v double, w double").select("point_id", *[rd(C(c), 6).alias(c) for c in "uvw"])


_uvw = lambda u, v, w: f"SELECT point_id, round({u}, 6) + 0.0 AS u, round({v}, 6) + 0.0 AS v, round({w}, 6) + 0.0 AS w FROM "
_default("affine", _uvw(f"1.2 + {_G} * (0.8 * dx + 0.2 * dy - 0.3 * dz)", f"-0.4 + {_G} * (0.2 * dx - 0.5 * dy)", f"0.3 + {_G} * (-0.3 * dx + 0.4 * dz)") + "c")
_default("sinusoid", _uvw("sin(2 * pi() / 160 * x)", "0.0", "0.0") + "c")
_default("inclusion", ", s AS (SELECT *, CASE WHEN sqrt(dx*dx + dy*dy + dz*dz) > 26.5 THEN 1 - 0.8::DOUBLE * pow(26.5 / sqrt(dx*dx + dy*dy + dz*dz), 3) ELSE 0.2::DOUBLE END AS s FROM c) " + _uvw(f"s * 1.5 * {_G} * dx", f"s * -0.75 * {_G} * dy", f"s * -0.75 * {_G} * dz") + "s")


def _boxes(spark, d, low, high, spacing: float):
    """A box for each supplier, from columns of k, its number."""
    k = C("s_suppkey").cast("long")
    ends = [c.cast("double").alias(f"{e}_{a}") for e, cs in (("lo", low(k)), ("hi", high(k))) for a, c in zip("xyz", cs, strict=True)]
    return table(spark, d, "supplier").select(k.alias("k"), *ends, F.lit(spacing).alias("spacing"))


def _lattice_sql(low, high, spacing: float) -> str:
    """g: k, id, x, y, z of a lattice for each supplier; b: its boxes."""
    ends = ", ".join(f"({v})::DOUBLE AS {e}_{a}" for e, vs in (("lo", low), ("hi", high)) for a, v in zip("xyz", vs, strict=True))
    n = ", ".join(f"greatest(floor((hi_{a} - lo_{a} + 1e-9) / {spacing}) + 1, 0)::BIGINT AS n{a}" for a in "xyz")
    return f"b AS (SELECT k, {ends} FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)), n AS (SELECT *, {n} FROM b), g AS (SELECT k, (i.i * ny + j.i) * nz + l.i AS id, lo_x + {spacing}::DOUBLE * i.i AS x, lo_y + {spacing}::DOUBLE * j.i AS y, lo_z + {spacing}::DOUBLE * l.i AS z FROM n, range(20) i(i), range(20) j(i), range(20) l(i) WHERE i.i < nx AND j.i < ny AND l.i < nz)"


_LOW, _HIGH = ("k % 5", "k % 4", "k % 3"), ("k % 5 + 20 + k % 13", "k % 4 + 20 + k % 7", "k % 3 + 20 + k % 11")


@query("grid_points", f"WITH {_lattice_sql(_LOW, _HIGH, 10.0)}, o AS (SELECT g.k, g.id, row_number() OVER (PARTITION BY g.k ORDER BY sqrt((x - (lo_x + hi_x) / 2) * (x - (lo_x + hi_x) / 2) + (y - (lo_y + hi_y) / 2) * (y - (lo_y + hi_y) / 2) + (z - (lo_z + hi_z) / 2) * (z - (lo_z + hi_z) / 2)), id) AS n FROM g JOIN b ON g.k = b.k), m AS (SELECT k, id AS centre FROM o WHERE n = 1) SELECT g.k, CAST(CASE WHEN id = centre THEN 0 WHEN id = 0 THEN centre ELSE id END + 1 AS BIGINT) AS point_id, x, y, z FROM g JOIN m ON g.k = m.k")
def grid_points(spark, d):
    """A lattice over a box for each supplier, the point nearest the middle first."""
    b = _boxes(spark, d, lambda k: (k % 5, k % 4, k % 3), lambda k: (k % 5 + 20 + k % 13, k % 4 + 20 + k % 7, k % 3 + 20 + k % 11), 10.0)
    return cases.centre_first(cases.lattices(b), b, "k")


_SHAPE = ("100 + k % 60", "90 + k % 50", "110 + k % 40")
_MANY = [f"16 * floor((({n} - 1) / 2.0::DOUBLE - 20 + 1e-9) / 16)" for n in _SHAPE]


def _shape_of(k):
    return 100 + k % 60, 90 + k % 50, 110 + k % 40


@query("case_points", f"WITH {_lattice_sql([f'({n} - 1) / 2.0::DOUBLE - {m}' for n, m in zip(_SHAPE, _MANY, strict=True)], [f'({n} - 1) / 2.0::DOUBLE + {m}' for n, m in zip(_SHAPE, _MANY, strict=True)], 16.0)} SELECT k, x, y, z FROM g")
def case_points(spark, d):
    """Lattices through the middles of volumes, no nearer than 20 to a face."""
    half = lambda k: [(n - 1) / 2 for n in _shape_of(k)]
    many = lambda h: 16.0 * F.floor((h - 20 + 1e-9) / 16)
    b = _boxes(spark, d, lambda k: [h - many(h) for h in half(k)], lambda k: [h + many(h) for h in half(k)], 16.0)
    return cases.lattices(b).select("k", "x", "y", "z")


@query("beads_points", f"WITH {_lattice_sql(['28'] * 3, [f'{n} - 29' for n in _SHAPE], 20.0)} SELECT k, x, y, z FROM g")
def beads_points(spark, d):
    """Lattices that begin 28 from the lower faces and end no nearer to the upper ones."""
    return cases.lattices(_boxes(spark, d, lambda k: [F.lit(28)] * 3, lambda k: [n - 29 for n in _shape_of(k)], 20.0)).select("k", "x", "y", "z")


@query("dvc1_points", f"""WITH {VOX}, mask AS (SELECT x, y, z FROM vox WHERE v % 10 < 9), d AS (SELECT max(z) AS top FROM vox),
p AS (SELECT 3.0::DOUBLE * a.i AS x, 0.5::DOUBLE + 3 * b.i AS y, (top % 3) / 2.0::DOUBLE + 3 * c.i AS z FROM d, range(14) a(i), range(11) b(i), range((SELECT top // 3 + 1 FROM d)) c(i)),
v AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) AS vx, CAST(round_even(y, 0) AS BIGINT) AS vy, CAST(round_even(z, 0) AS BIGINT) AS vz FROM p WHERE y <= 31)
SELECT v.x, v.y, v.z FROM v, range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i), mask m WHERE a.i * a.i + b.i * b.i + c.i * c.i < 2.25 AND m.x = vx + a.i AND m.y = vy + b.i AND m.z = vz + c.i GROUP BY ALL HAVING count(*) = 19""")
def dvc1_points(spark, d):
    """A lattice inside a mask that is made from events and eroded by 1.5 voxels."""
    v = vox(spark, d)
    shape = (NX, NY, v.agg(F.max("z")).first()[0] + 1)
    mask = bricks_of_voxels(v.where("v % 10 < 9").select("x", "y", "z", F.lit(1).alias("v")), shape, BRICK, "u1")
    return cases.in_mask(cases.centred_grid(spark, shape, 3.0), mask, shape, BRICK, 1.5, tile=16.0)


@query("named_cases", f"""WITH {RESULTS}, e AS (SELECT a.point_id % 27 AS k, a.status AS s, a.v - t.v AS ev FROM res_a a JOIN truth t USING (point_id)),
c AS (SELECT *, CASE WHEN k < 6 THEN 'repeat' WHEN k < 8 THEN 'axial' WHEN k < 10 THEN 'radial' WHEN k < 21 THEN 'translation' ELSE 'stretch' END AS "group", CASE WHEN k < 10 THEN (CASE WHEN k < 6 THEN [24, 24, 32, 32, 48, 48][k + 1] ELSE 32 END) ELSE 40 END AS size FROM e)
SELECT "group", count(DISTINCT k)::INT AS cases, min(size)::DOUBLE AS least, max(size)::DOUBLE AS most, count(*) AS points, count(*) FILTER (WHERE s = 0) AS good, round(avg(ev) FILTER (WHERE s = 0), 9) AS bias_v FROM c GROUP BY "group\"""")
def named_cases(spark, d):
    """Results by the public cases' groups; points are dealt to the 27 cases by their id."""
    rows = [(k, c.name, c.group, c.size) for k, c in enumerate(cases.named_cases())]
    named = spark.createDataFrame(rows, "k long, name string, group string, size double")
    m = with_error(match(res_a(spark, d), truth(pts(spark, d)).select("point_id", "u", "v", "w"))).withColumn("k", C("point_id") % 27)
    good = C("a_status") == 0
    return m.join(F.broadcast(named), "k").groupBy("group").agg(F.count_distinct("name").cast("int").alias("cases"), F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("points"), F.count(F.when(good, 1)).alias("good"), F.round(F.avg(F.when(good, C("ev"))), 9).alias("bias_v"))


@query("error_floor_cases", f"""SELECT CAST(s_suppkey AS BIGINT) AS k, (s_suppkey % 11) / 10.0::DOUBLE AS shift, CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE 'diagonal' END AS direction, CASE WHEN s_suppkey % 3 = 0 THEN 'symmetric' ELSE 'one-sided' END AS variant,
round((CASE WHEN s_suppkey % 3 = 0 THEN -0.5 ELSE 0 END)::DOUBLE * (s_suppkey % 11) / 10.0 * (CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE {1 / math.sqrt(3)!r} END)::DOUBLE, 9) + 0.0 AS ref_x, round((CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 1 END)::DOUBLE * (s_suppkey % 11) / 10.0 * (CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE {1 / math.sqrt(3)!r} END)::DOUBLE, 9) + 0.0 AS def_y FROM supplier""")
def error_floor_cases(spark, d):
    """Both images' shifts of a case for each supplier."""
    k = C("s_suppkey").cast("long")
    axis = F.create_map(*[v for n, dxyz in studies.DIRECTIONS.items() for v in (F.lit(n), F.array(*map(F.lit, dxyz)))])
    name = F.when(k % 2 == 0, "x").otherwise("diagonal")
    p = table(spark, d, "supplier").select(k.alias("k"), ((k % 11) / 10.0).alias("shift"), name.alias("direction"), F.when(k % 3 == 0, "symmetric").otherwise("one-sided").alias("variant"))
    p = p.select("*", *[F.element_at(axis, C("direction"))[i].alias(f"d{a}") for i, a in enumerate("xyz")])
    return studies.with_shifts(p).select("k", "shift", "direction", "variant", rd(C("ref_x")).alias("ref_x"), rd(C("def_y")).alias("def_y"))


@query("study_variants", f"""WITH {RESULTS}, r AS (SELECT 'a' AS variant, * FROM res_a UNION ALL SELECT 'b', * FROM res_b UNION ALL SELECT 'c', * FROM res_c),
j AS (SELECT p.variant AS one, q.variant AS other, p.status AS sa, q.status AS sb, CASE WHEN p.status = 0 AND q.status = 0 THEN sqrt((p.u-q.u)*(p.u-q.u) + (p.v-q.v)*(p.v-q.v) + (p.w-q.w)*(p.w-q.w)) END AS far FROM r p JOIN r q ON p.point_id = q.point_id AND p.variant < q.variant)
SELECT one, other, count(*) AS points, round(avg(CASE WHEN sa = sb THEN 1.0 ELSE 0.0 END), 9) AS status_agreement, count(far) AS good_both, round(quantile_cont(far, 0.5), 9) AS p50, round(quantile_cont(far, 0.95), 9) AS p95 FROM j GROUP BY ALL""")
def study_variants(spark, d):
    runs = [f(spark, d).withColumn("variant", F.lit(n)) for n, f in (("a", res_a), ("b", res_b), ("c", res_c))]
    p = studies.variant_pairs(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    return p.select("one", "other", "points", rd(C("status_agreement")).alias("status_agreement"), "good_both", rd(C("p50")).alias("p50"), rd(C("p95")).alias("p95"))


@query("density_sweep", f"WITH {PTS}, s AS (SELECT unnest([8, 16, 32]) AS spacing), p AS (SELECT spacing, point_id, sqrt((x-64)*(x-64) + (y-64)*(y-64) + (z-64)*(z-64)) AS dist FROM pts, s WHERE x % spacing = 0 AND y % spacing = 0 AND z % spacing = 0), r AS (SELECT spacing, CASE WHEN row_number() OVER (PARTITION BY spacing ORDER BY dist, point_id) = 1 THEN -1 ELSE floor(dist / spacing) END AS ring FROM p) SELECT CAST(spacing AS DOUBLE) AS spacing, count(*) AS points, CAST(count(DISTINCT ring) AS INT) AS shells FROM r GROUP BY spacing")
def density_sweep(spark, d):
    """Points and shells of ever sparser lattices out of one cloud (what a sweep of timings is plotted against)."""
    from corrvox.operators.seeding import wavefront_shells

    out = None
    for s in (8.0, 16.0, 32.0):
        g = pts(spark, d).where((C("x") % s == 0) & (C("y") % s == 0) & (C("z") % s == 0))
        row = wavefront_shells(g, (64.0, 64.0, 64.0), s).agg(F.count(F.lit(1)).alias("points"), (F.max("shell") + 1).cast("int").alias("shells")).select(F.lit(s).alias("spacing"), "points", "shells")
        out = row if out is None else out.unionByName(row)
    return out


@query("load_pair", f"WITH {RESULTS}, j AS (SELECT a.point_id, a.x, a.y, a.z, a.status AS a_status, a.u AS au, a.v AS av, a.w AS aw, b.status AS b_status, b.u AS bu, b.v AS bv, b.w AS bw FROM res_a a JOIN res_b b USING (point_id)), k AS (SELECT *, NOT ({_EDGE} OR {_EDGE.replace('bu', 'au').replace('bv', 'av').replace('bw', 'aw')}) AS interior FROM j) SELECT point_id, interior, a_status = 0 AND interior AS a_good, b_status = 0 AND interior AS b_good FROM k")
def load_pair(spark, d):
    return studies.load_pair(res_a(spark, d), res_b(spark, d), (160, 160, 200), 6.0).select("point_id", "interior", "a_good", "b_good")


@query("load_pair_truth", f"WITH {RESULTS}, j AS (SELECT a.point_id, a.x, a.y, a.z, t.u AS bu, t.v AS bv, t.w AS bw FROM res_a a JOIN res_b b USING (point_id) JOIN truth t USING (point_id)) SELECT point_id, NOT {_EDGE} AS interior FROM j")
def load_pair_truth(spark, d):
    return studies.load_pair(res_a(spark, d), res_b(spark, d), (160, 160, 200), 6.0, truth(pts(spark, d))).select("point_id", "interior")


@query("self_agreement", f"WITH {RESULTS} SELECT count(*) AS n, count(*) FILTER (WHERE a.status = c.status) AS status_same, round(max(greatest(abs(a.u - c.u), abs(a.v - c.v), abs(a.w - c.w))) FILTER (WHERE a.status = c.status), 9) AS max_abs FROM res_a a JOIN res_c c USING (point_id)")
def self_agreement(spark, d):
    return studies.self_agreement(res_a(spark, d), res_c(spark, d)).select("n", "status_same", rd(C("max_abs")).alias("max_abs"))


@query("complete_cells", f"WITH {RESULTS}, c AS (SELECT point_id, CAST(floor(x / 32) AS BIGINT) AS cx, CAST(floor(y / 32) AS BIGINT) AS cy, CAST(floor(z / 32) AS BIGINT) AS cz, point_id % 400 AS k FROM pts) SELECT cx, cy, cz FROM c WHERE k < 300 INTERSECT SELECT cx, cy, cz FROM c WHERE k > 100 INTERSECT SELECT cx, cy, cz FROM c WHERE point_id % 3 = 0")
def complete_cells(spark, d):
    c = pts(spark, d).select("point_id", *[F.floor(C(a) / 32).cast("long").alias(f"c{a}") for a in "xyz"], (C("point_id") % 400).alias("k"))
    return studies.complete_cells([c.where("k < 300"), c.where("k > 100"), c.where("point_id % 3 = 0")])


@query("junit_counts", "SELECT CAST(sum(user_id) AS BIGINT) AS tests, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'signup') AS errors, count(*) FILTER (WHERE event_type = 'view') AS skipped FROM events")
def junit_counts(spark, d):
    flag = lambda k: F.when(C("event_type") == k, 1).otherwise(0)
    return studies.junit_counts(table(spark, d, "events").select(C("user_id").alias("tests"), flag("error").alias("failures"), flag("signup").alias("errors"), flag("view").alias("skipped")))


_STEPS = "s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'skip' ELSE 'pass' END AS status, CASE WHEN event_id % 2 = 0 THEN 'case A run' ELSE 'kernel' END AS name FROM events WHERE event_id % 4 < 2)"


@query("report_verdict", f"WITH {_STEPS} SELECT user_id, CASE WHEN bool_or(status = 'fail') THEN 'FAIL' WHEN bool_or(status = 'warn') THEN 'WARN' WHEN bool_or(status = 'skip' AND starts_with(name, 'case A')) THEN 'PASS (partial)' ELSE 'PASS' END AS verdict, CASE WHEN bool_or(status = 'fail') OR bool_or(status = 'skip' AND starts_with(name, 'case A')) THEN 'FAIL' WHEN bool_or(status = 'warn') THEN 'WARN' ELSE 'PASS' END AS strict FROM s GROUP BY user_id")
def report_verdict(spark, d):
    kind = C("event_type")
    status = F.when(kind == "error", "fail").when(kind == "signup", "warn").when(kind == "click", "skip").otherwise("pass")
    s = table(spark, d, "events").where("event_id % 4 < 2").select("user_id", status.alias("status"), F.when(C("event_id") % 2 == 0, "case A run").otherwise("kernel").alias("name"))
    return s.groupBy("user_id").agg(studies.verdict().alias("verdict"), studies.verdict(required=True).alias("strict"))


@query("textureless", f"WITH {SUBVOL} SELECT vec_id, vec_id % 3 = 0 OR max(f) - min(f) <= 1e-12 * max(abs(f)) AS textureless FROM samp GROUP BY vec_id")
def textureless(spark, d):
    s = subvol(spark, d).select("vec_id", F.when(C("vec_id") % 3 == 0, F.transform("f", lambda x: F.lit(7.0))).otherwise(C("f")).alias("f"))
    return s.select("vec_id", arrays.textureless(C("f")).alias("textureless"))


@query("sphere_template", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 200 + s_suppkey % 7 AS samples, true AS inside, true AS z_ordered, true AS same_again FROM supplier")
def sphere_template(spark, d):
    """Sample sets of a ball: as many as asked for, inside, z slowest, the same for the same seed."""

    def run(batches):
        for b in batches:
            rows = []
            for k in b["s_suppkey"]:
                o = sphere_offsets(200 + int(k) % 7, 20.0, int(k))
                rows.append((len(o), bool((np.sqrt((o**2).sum(1)) <= 10.00001).all()), bool((np.diff(o[:, 2]) >= 0).all()), bool((o == sphere_offsets(200 + int(k) % 7, 20.0, int(k))).all())))
            yield b.assign(**dict(zip(("samples", "inside", "z_ordered", "same_again"), zip(*rows, strict=True), strict=True)))

    return table(spark, d, "supplier").select(C("s_suppkey").cast("long")).mapInPandas(run, "s_suppkey long, samples long, inside boolean, z_ordered boolean, same_again boolean")


@query("speckle", "SELECT CAST(24 * 16 * 8 * ceil(count(*) / 8.0) AS BIGINT) AS voxels, true AS near_middle, true AS spread, true AS same_by_brick FROM supplier")
def speckle(spark, d):
    """A speckle image, a layer of bricks for eight suppliers: middle grey, spread by an eighth of the scale, the same whatever its bricks are dealt to."""
    from corrvox.plans.correlate import speckle_bricks

    shape = (24, 16, 8 * -(-table(spark, d, "supplier").count() // 8))
    place = ["bx", "by", "bz"]
    again = speckle_bricks(spark, shape, 8, 3.0, 5).repartition(shuffles(spark), *place).select(*place, C("data").alias("again"))
    # What Python makes is estimated by the bytes of its input, so a join of voxels would be sent to the driver: bricks meet, by a shuffle.
    both = cut(speckle_bricks(spark, shape, 8, 3.0, 5).join(again.hint("merge"), place))
    same = both.agg(F.bool_and(C("data") == C("again")).alias("same_by_brick"))
    v = voxel_rows(both, 8).agg(F.count(F.lit(1)).alias("voxels"), (F.abs(F.avg("v") - 32768) < 3000).alias("near_middle"), F.stddev_pop("v").between(4000, 12000).alias("spread"))
    return v.join(F.broadcast(same), how="left")  # a row each


@query("closing_lines", f"WITH {RESULTS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 0) AS n0, count(*) FILTER (WHERE status = -1) AS n1, count(*) FILTER (WHERE status = -2) AS n2 FROM res_a) SELECT CAST(unnest(range(0, 10)) AS INT) AS place, unnest(['Run start:' || chr(9) || '1970-01-01 00:00:00', 'Run finish:' || chr(9) || '1970-01-01 00:00:08', n || ' points processed in 8 seconds', printf('%.3f sec/pt', 8.0::DOUBLE / n), printf('%.3f pt/sec', n / 8.0::DOUBLE), '', " + ", ".join(f"'number {label} = ' || n{k} || chr(9) || printf('(%.3f%%)', 100.0::DOUBLE * n{k} / n)" for k, label in enumerate(("successful", "range fail", "convg fail"))) + ", '']) AS line FROM t")
def closing_lines(spark, d):
    return text.closing_lines(res_a(spark, d), 0.0, 8.0, 8.0)


_ECHO = {"reference_filename": "a.raw", "vol_bit_depth": "16", "vol_wide": "128", "subvol_size": "24.5", "subvol_thresh": "off", "disp_max": "15", "obj_function": "znssd", "rigid_trans": "1.0, 0 -0.50", "starting_point": "1 2 3"}


@query("echo_lines", f"WITH {PTS}, b AS (SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM pts), l AS (SELECT ['', '### echo of the input file for this run', '', 'reference_filename' || chr(9) || 'a.raw', '', 'vol_bit_depth' || chr(9) || '16', 'vol_wide' || chr(9) || '128', '', 'subvol_size' || chr(9) || '24.5', '', 'subvol_thresh' || chr(9) || 'off', '', 'disp_max' || chr(9) || '15', 'obj_function' || chr(9) || 'znssd', '', 'rigid_trans' || chr(9) || '1' || chr(9) || '0' || chr(9) || '-0.5', '', '### end of input file echo', '', 'Point Cloud contains ' || n || ' points', '', chr(9) || printf('bounding box min = [%d %d %d]', x0::BIGINT, y0::BIGINT, z0::BIGINT), chr(9) || printf('bounding box max = [%d %d %d]', x1::BIGINT, y1::BIGINT, z1::BIGINT), '', 'running under corrvox', ''] AS l FROM b) SELECT CAST(unnest(range(0, len(l))) AS INT) AS place, unnest(l) AS line FROM l")
def echo_lines(spark, d):
    return text.echo_lines(_ECHO, pts(spark, d))


@query("progress_lines", f"WITH {RESULTS} SELECT point_id + 1 AS place, printf('%d/500 %d', point_id + 1, point_id) || chr(9) || printf('%.3f %.3f %.3f ', x, y, z) || chr(9) || (CASE status WHEN 0 THEN 'Point_Good' || chr(9) || printf('obj= %.6f        dx= %.6f        dy= %.6f        dz= %.6f', round(objmin, 4), round(u, 4), round(v, 4), round(w, 4)) WHEN -1 THEN 'Range_Fail' ELSE 'Convg_Fail' END) AS line FROM res_a")
def progress_lines(spark, d):
    r = res_a(spark, d).select("point_id", (C("point_id") + 1).alias("place"), "x", "y", "z", "status", *[F.round(c, 4).alias(c) for c in ("objmin", "u", "v", "w")])
    return text.progress_lines(r, 500)


@query("write_dvc_input", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'subvol_size' AS key, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey, 'subvol_npts', CAST(500 + p_partkey AS VARCHAR) FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey, 'vol_bit_depth', '16' FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey, 'vol_endian', 'big' FROM part WHERE p_partkey < 50 UNION ALL SELECT p_partkey, 'rigid_trans', '1 0 -0.5' FROM part WHERE p_partkey < 50")
def write_dvc_input(spark, d):
    """Settings written as classic programs read them, and read again."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                cfg = build(RunConfig, {"volumes": {"reference": "a.raw", "deformed": "b.raw"}, "points": "p", "output": "o", "subvolume": {"geometry": "cube", "size": float(r.p_size), "n_samples": 500 + int(r.p_partkey)}, "search": {"rigid_trans": [1.0, 0.0, -0.5]}})
                rows += [(r.p_partkey, n, line) for n, line in enumerate(text.settings_lines(cfg, (1.0, 2.0, 3.0), (10, 11, 12), ">u2"))]
            yield type(b)(rows, columns=["p_partkey", "line_no", "line"])

    lines = table(spark, d, "part").where("p_partkey < 50").select(C("p_partkey").cast("long"), "p_size").mapInPandas(run, "p_partkey long, line_no long, line string")
    keyed = text.parse_settings(lines.select((C("p_partkey") * 1000 + C("line_no")).alias("line_no"), "line"))
    return keyed.where(C("key").isin("subvol_size", "subvol_npts", "vol_bit_depth", "vol_endian", "rigid_trans")).select(F.floor(C("line_no") / 1000).cast("long").alias("p_partkey"), "key", "value")


@query("strain_csv", f"WITH {PTS} SELECT point_id, concat_ws(',', point_id, CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(z AS BIGINT), '0.015625,0.0078125,0,-0.5,0,0,0,0,0.25') AS line FROM pts")
def strain_csv(spark, d):
    p = pts(spark, d)
    s = p.select("point_id", *[F.lit(0.0).alias(f"{c}_fit") for c in "uvw"], F.lit(25).alias("pts_in_sw"), F.lit(1.5).alias("sw_radius"), F.array(*[F.lit(v) for v in (0.015625, 0.0078125, 0.0, -0.5, 0.0, 0.0, 0.0, 0.0, 0.25)]).alias("grad"))
    head, lines = text.strain_lines(s, p, "dgrd")
    assert head.endswith("wx,wy,wz")
    return lines.select("point_id", F.regexp_replace("line", "^((?:[^,]*,){4})0,0,0,25,1.5,", "$1").alias("line"))


@query("strain_planar", f"WITH {PTS} SELECT point_id, 0.015625::DOUBLE AS exx, 0.0::DOUBLE AS eyy, 0.0::DOUBLE AS ezz, round(-1.0 / 256, 6) AS exy, 0.0::DOUBLE AS ep3 FROM pts WHERE z = 0")
def strain_planar(spark, d):
    r = truth(pts(spark, d).where("z = 0")).withColumn("status", F.lit(0)).withColumn("objmin", F.lit(0.0))
    return strain.strain(r, 9, 16.0).select("point_id", *[rd(C(c), 6).alias(c) for c in ("exx", "eyy", "ezz", "exy", "ep3")])
