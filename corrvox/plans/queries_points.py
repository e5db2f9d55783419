"""Point clouds: neighbours, shells, seeds, cells, windows and strain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrvox.operators import seeding, strain
from corrvox.operators.knn import knn, median_spacing
from corrvox.operators.tables import dealt
from corrvox.plans.fixtures import PTS, RESULTS, TRUTH, div, pts, rd, res_a, table, truth
from corrvox.plans.queries_geometry import MORTON_SQL, morton
from corrvox.plans.registry import query

C = F.col
_NEAR = """g AS (SELECT *, CAST(floor(x / 16) AS BIGINT) AS cx, CAST(floor(y / 16) AS BIGINT) AS cy, CAST(floor(z / 16) AS BIGINT) AS cz FROM {t}),
o(d) AS (VALUES (-1), (0), (1)), q AS (SELECT point_id, x, y, z, cx + a.d AS cx, cy + b.d AS cy, cz + c.d AS cz FROM (SELECT point_id, x, y, z, CAST(floor(x / 16) AS BIGINT) AS cx, CAST(floor(y / 16) AS BIGINT) AS cy, CAST(floor(z / 16) AS BIGINT) AS cz FROM pts), o a, o b, o c),
nn AS (SELECT q.point_id, g.point_id AS neighbour_id, (q.x-g.x)*(q.x-g.x) + (q.y-g.y)*(q.y-g.y) + (q.z-g.z)*(q.z-g.z) AS d2 FROM q JOIN g USING (cx, cy, cz)),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, neighbour_id) AS rank FROM nn WHERE {cond})"""


@query("knn", f"WITH {PTS}, {_NEAR.format(t='pts', cond='point_id <> neighbour_id')} SELECT point_id, neighbour_id, round(sqrt(d2), 9) AS distance, rank FROM rk WHERE rank <= 6")
def knn_query(spark, d):
    p = pts(spark, d)
    return knn(p, p, 6, 16.0).select("point_id", "neighbour_id", rd(C("distance")).alias("distance"), "rank")


@query("median_spacing", f"WITH {PTS}, {_NEAR.format(t='pts', cond='point_id <> neighbour_id')} SELECT round(quantile_cont(sqrt(d2), 0.5), 9) AS spacing FROM rk WHERE rank = 1")
def median_spacing_query(spark, d):
    return median_spacing(pts(spark, d), 16.0).select(rd(C("spacing")).alias("spacing"))


@query("processing_order", f"WITH {PTS} SELECT point_id, row_number() OVER (ORDER BY sqrt((x-80)*(x-80) + (y-80)*(y-80) + (z-40)*(z-40)), point_id) AS place FROM pts")
def processing_order(spark, d):
    """Places by distance from the start. Slabs of distance are counted first, so no task sorts the whole cloud."""
    p = seeding.with_distance(pts(spark, d), (80, 80, 40)).withColumn("slab", F.floor(C("distance") / 8))
    n = p.groupBy("slab").count()
    before = n.withColumn("before", F.sum("count").over(Window.orderBy("slab")) - C("count")).select("slab", "before")
    within = F.row_number().over(Window.partitionBy("slab").orderBy("distance", "point_id"))
    return p.withColumn("n", within).join(F.broadcast(before), "slab").select("point_id", (C("before") + C("n")).alias("place"))


@query("first_n_points", f"WITH {PTS} SELECT point_id FROM pts ORDER BY sqrt((x-80)*(x-80) + (y-80)*(y-80) + (z-40)*(z-40)), point_id LIMIT 100")
def first_n_points(spark, d):
    """num_points_to_process: the first points in order of processing (a top-k, not a sort)."""
    return seeding.with_distance(pts(spark, d), (80, 80, 40)).orderBy("distance", "point_id").limit(100).select("point_id")


@query("wavefront_shells", f"WITH {PTS}, e AS (SELECT point_id, sqrt((x-80)*(x-80) + (y-80)*(y-80) + (z-40)*(z-40)) AS dist FROM pts), r AS (SELECT point_id, CASE WHEN row_number() OVER (ORDER BY dist, point_id) = 1 THEN -1 ELSE CAST(floor(dist / 8) AS BIGINT) END AS ring FROM e) SELECT point_id, CAST(dense_rank() OVER (ORDER BY ring) - 1 AS INT) AS shell FROM r")
def wavefront_shells(spark, d):
    return seeding.wavefront_shells(pts(spark, d), (80, 80, 40), 8.0).select("point_id", "shell")


@query("shell_sizes", f"WITH {PTS}, e AS (SELECT point_id, sqrt((x-80)*(x-80) + (y-80)*(y-80) + (z-40)*(z-40)) AS dist FROM pts), r AS (SELECT point_id, CASE WHEN row_number() OVER (ORDER BY dist, point_id) = 1 THEN -1 ELSE CAST(floor(dist / 8) AS BIGINT) END AS ring FROM e) SELECT CAST(dense_rank() OVER (ORDER BY ring) - 1 AS INT) AS shell, count(*) AS points FROM r GROUP BY ring")
def shell_sizes(spark, d):
    return wavefront_shells(spark, d).groupBy("shell").agg(F.count(F.lit(1)).alias("points"))


@query("coarse_subset", f"WITH {PTS} SELECT point_id FROM pts WHERE x % 16 = 0 AND y % 16 = 0 AND z % 16 = 0")
def coarse_subset(spark, d):
    return seeding.coarse_subset(pts(spark, d), 2, 8.0).select("point_id")


@query("seed_from_neighbours", f"WITH {RESULTS}, {_NEAR.format(t='pts', cond='point_id <> neighbour_id')}, s AS (SELECT rk.point_id, avg(r.u) AS su, avg(r.v) AS sv, avg(r.w) AS sw FROM rk JOIN res_a r ON r.point_id = rk.neighbour_id AND r.status = 0 AND r.point_id % 3 = 0 WHERE rank <= 6 GROUP BY rk.point_id) SELECT p.point_id, round(coalesce(su, 1.0), 9) + 0.0 AS su, round(coalesce(sv, 0.0), 9) + 0.0 AS sv, round(coalesce(sw, 0.5), 9) + 0.0 AS sw FROM pts p LEFT JOIN s USING (point_id)")
def seed_from_neighbours(spark, d):
    p = pts(spark, d)
    s = seeding.seed_from_neighbours(knn(p, p, 6, 16.0), res_a(spark, d).where("point_id % 3 = 0"), (1.0, 0.0, 0.5), p)
    return s.select("point_id", *[rd(C(f"s{c}")).alias(f"s{c}") for c in "uvw"])


@query("interpolate_seed_field", f"""WITH {RESULTS}, co AS (SELECT * FROM res_a WHERE status = 0 AND x % 16 = 0 AND y % 16 = 0 AND z % 16 = 0),
r AS (SELECT p.point_id, sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z)) AS dist, c.u, c.v, c.w, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z), c.point_id) AS k FROM pts p, co c WHERE abs(p.x-c.x) <= 80 AND abs(p.y-c.y) <= 80 AND abs(p.z-c.z) <= 80),
m AS (SELECT point_id, min(dist) AS near, {", ".join(f"arg_min({c}, k) AS e{c}, sum({c} / greatest(dist, 1e-12) / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12) / greatest(dist, 1e-12)) AS m{c}" for c in "uvw")} FROM r WHERE k <= 8 GROUP BY point_id)
SELECT point_id, {", ".join(f"round((CASE WHEN near < 1e-9 THEN e{c} ELSE m{c} END) + 3e-11, 8) + 0.0 AS s{c}" for c in "uvw")} FROM m""")
def interpolate_seed_field(spark, d):
    a = res_a(spark, d)
    s = seeding.interpolate_seeds(pts(spark, d), seeding.coarse_subset(a, 2, 8.0), 8, 32.0, (0.0, 0.0, 0.0))
    return s.select("point_id", *[rd(C(f"s{c}") + 3e-11, 8).alias(f"s{c}") for c in "uvw"])


@query("lookup_seeds", f"WITH {RESULTS} SELECT p.point_id, round(coalesce(r.u, 1.5), 9) AS su, round(coalesce(r.v, -0.5), 9) + 0.0 AS sv, round(coalesce(r.w, 0.25), 9) AS sw FROM pts p LEFT JOIN (SELECT * FROM res_a WHERE status = 0) r USING (point_id)")
def lookup_seeds(spark, d):
    field = res_a(spark, d).where("status = 0").select("point_id", *[C(c).alias(f"s{c}") for c in "uvw"])
    return seeding.lookup_seeds(pts(spark, d), field, (1.5, -0.5, 0.25)).select("point_id", *[rd(C(f"s{c}")).alias(f"s{c}") for c in "uvw"])


@query("strain_window", f"WITH {RESULTS}, {_NEAR.format(t='pts', cond='true')} SELECT rk.point_id, count(*) FILTER (WHERE r.status = 0 AND r.objmin <= 0.1) AS pts_in_sw, round(coalesce(max(sqrt(d2)) FILTER (WHERE r.status = 0 AND r.objmin <= 0.1), 0), 9) AS sw_radius FROM rk JOIN res_a r ON r.point_id = rk.neighbour_id WHERE rank <= 7 GROUP BY rk.point_id")
def strain_window(spark, d):
    p = pts(spark, d)
    w = strain.windows(res_a(spark, d), 7, 16.0, 0.1).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r"))
    return p.join(w, "point_id", "left").select("point_id", F.coalesce("n", F.lit(0)).alias("pts_in_sw"), rd(F.coalesce("r", F.lit(0.0))).alias("sw_radius"))


@query("strain_refill", f"WITH {RESULTS}, {_NEAR.format(t='pts', cond='true')}, s AS (SELECT rk.*, sum(CASE WHEN r.status = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rk.point_id ORDER BY rank) AS seen, r.status FROM rk JOIN res_a r ON r.point_id = rk.neighbour_id WHERE rank <= 19) SELECT point_id, count(*) FILTER (WHERE status = 0 AND seen <= 3) AS pts_in_sw, round(max(sqrt(d2)) FILTER (WHERE status = 0 AND seen <= 3), 9) AS sw_radius FROM s GROUP BY point_id HAVING count(*) FILTER (WHERE status = 0 AND seen <= 3) > 0")
def strain_refill(spark, d):
    w = strain.windows(res_a(spark, d), 3, 16.0, 1e9, refill=True)
    return w.groupBy("point_id").agg(F.count(F.lit(1)).alias("pts_in_sw"), rd(F.max("distance")).alias("sw_radius"))


@query("strain_fit", f"WITH {TRUTH} SELECT point_id, round(1.0 / 64, 6) AS exx, 0.0 AS eyy, 0.0 AS ezz, round(-1.0 / 256, 6) AS exy, round((1.0 / 256 + 1.0 / 512) / 2, 6) AS eyz, round(1.0 / 1024, 6) AS exz, round(u, 6) + 0.0 AS u_fit, CAST(25 AS INT) AS pts_in_sw FROM truth")
def strain_fit(spark, d):
    """On an exactly affine displacement every window returns its gradient (known answer)."""
    r = truth(pts(spark, d)).withColumn("status", F.lit(0)).withColumn("objmin", F.lit(0.0))
    s = strain.strain(r, 25, 16.0)
    return s.select("point_id", *[rd(C(n), 6).alias(n) for n in strain.NAMES], rd(C("u_fit"), 6).alias("u_fit"), "pts_in_sw")


@query("planar_axis", f"WITH {PTS} SELECT CAST(CASE WHEN max(z) - min(z) = 0 AND max(x) > min(x) AND max(y) > min(y) THEN 2 END AS INT) AS planar_axis FROM pts WHERE z = 8")
def planar_axis(spark, d):
    return strain.planar_axis(pts(spark, d).where("z = 8"))


@query("cell_counts", f"WITH {PTS} SELECT CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy, CAST(floor(z / 64) AS BIGINT) AS cz, count(*) AS points, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi FROM pts GROUP BY ALL")
def cell_counts(spark, d):
    """Counts and extents of the cells that hold points."""
    return pts(spark, d).groupBy(*[div(C(a), 64).alias(f"c{a}") for a in "xyz"]).agg(F.count(F.lit(1)).alias("points"), *[x for a in "xyz" for x in (F.min(a).alias(f"{a}_lo"), F.max(a).alias(f"{a}_hi"))])


_BIN = "CAST(least(greatest(floor(({a} - 64 * floor({a} / 64)) / 32), 0), 1) AS BIGINT)"


@query("cell_fragments", f"WITH {PTS}, b AS (SELECT point_id, CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy, CAST(floor(z / 64) AS BIGINT) AS cz, ({_BIN.format(a='x')} * 2 + {_BIN.format(a='y')}) * 2 + {_BIN.format(a='z')} AS bin FROM pts) SELECT point_id, cx, cy, cz, CAST(bin AS BIGINT) AS bin, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY bin, point_id) - 1 AS place FROM b")
def cell_fragments(spark, d):
    """Bin of each point in its cell (2 a side, x slowest) and its place in bin order."""
    bins = [F.least(F.greatest(F.floor((C(a) - 64 * F.floor(C(a) / 64)) / 32), F.lit(0)), F.lit(1)) for a in "xyz"]
    p = pts(spark, d).select("point_id", *[div(C(a), 64).alias(f"c{a}") for a in "xyz"], ((bins[0] * 2 + bins[1]) * 2 + bins[2]).cast("long").alias("bin"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("cx", "cy", "cz").orderBy("bin", "point_id")) - 1)


@query("bin_offsets", f"WITH {PTS}, b AS (SELECT CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy, CAST(floor(z / 64) AS BIGINT) AS cz, CAST(({_BIN.format(a='x')} * 2 + {_BIN.format(a='y')}) * 2 + {_BIN.format(a='z')} AS BIGINT) AS bin FROM pts), n AS (SELECT cx, cy, cz, bin, count(*) AS points FROM b GROUP BY ALL) SELECT cx, cy, cz, bin, points, CAST(sum(points) OVER (PARTITION BY cx, cy, cz ORDER BY bin) - points AS BIGINT) AS first FROM n")
def bin_offsets(spark, d):
    n = cell_fragments(spark, d).groupBy("cx", "cy", "cz", "bin").agg(F.count(F.lit(1)).alias("points"))
    return n.withColumn("first", (F.sum("points").over(Window.partitionBy("cx", "cy", "cz").orderBy("bin")) - C("points")).cast("long"))


@query("morton_order", f"WITH {PTS}, m AS (SELECT point_id, CAST({MORTON_SQL} AS BIGINT) AS code FROM pts) SELECT point_id, row_number() OVER (ORDER BY code, point_id) AS place, CAST((row_number() OVER (ORDER BY code, point_id) - 1) // 512 AS BIGINT) AS batch FROM m")
def morton_order(spark, d):
    """Places on the Z-order curve and batches of 512: ranges of codes are counted first."""
    p = morton(pts(spark, d), 12.0).withColumn("range", F.shiftright("code", 9))
    before = p.groupBy("range").count().withColumn("before", F.sum("count").over(Window.orderBy("range")) - C("count")).select("range", "before")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("code", "point_id"))).join(F.broadcast(before), "range")
    place = C("before") + C("n")
    return p.select("point_id", place.alias("place"), F.floor((place - 1) / 512).cast("long").alias("batch"))


@query("otsu_threshold", "WITH h AS (SELECT CAST(floor(value) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * (bin + 0.5::DOUBLE)) OVER (ORDER BY bin) AS m, sum(n) OVER () AS wt, sum(n * (bin + 0.5::DOUBLE)) OVER () AS mt FROM h) SELECT bin AS threshold FROM c ORDER BY round(pow(mt * w - m * wt, 2) / greatest(w * (wt - w), 1), 3) DESC, bin LIMIT 1")
def otsu_threshold(spark, d):
    """The histogram bin with the largest variance between the two sides (a row for each bin)."""
    h = table(spark, d, "events").groupBy(F.floor("value").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    moment = C("n") * (C("bin") + 0.5)
    run, whole = Window.orderBy("bin"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = h.select("bin", F.sum("n").over(run).alias("w"), F.sum(moment).over(run).alias("m"), F.sum("n").over(whole).alias("wt"), F.sum(moment).over(whole).alias("mt"))
    between = F.round(F.pow(C("mt") * C("w") - C("m") * C("wt"), 2) / F.greatest(C("w") * (C("wt") - C("w")), F.lit(1)), 3)
    return c.orderBy(between.desc(), "bin").limit(1).select(C("bin").alias("threshold"))


@query("centre_first", f"WITH {PTS}, o AS (SELECT *, row_number() OVER (ORDER BY point_id) AS n, row_number() OVER (ORDER BY (x-76)*(x-76) + (y-76)*(y-76) + (z-96)*(z-96), point_id) AS c FROM pts), k AS (SELECT n AS kn FROM o WHERE c = 1) SELECT point_id, CASE WHEN c = 1 THEN 1 WHEN n = 1 THEN kn ELSE n END AS place FROM o, k")
def centre_first(spark, d):
    """The point nearest the centre swaps places with the first; ids are dense here, so places follow from them."""
    p = pts(spark, d)
    d2 = (C("x") - 76) * (C("x") - 76) + (C("y") - 76) * (C("y") - 76) + (C("z") - 96) * (C("z") - 96)
    one = p.agg(F.min_by("point_id", F.struct(d2, C("point_id"))).alias("centre"), F.min("point_id").alias("low"))
    p = p.join(F.broadcast(one))
    return p.select("point_id", (F.when(C("point_id") == C("centre"), C("low")).when(C("point_id") == C("low"), C("centre")).otherwise(C("point_id")) - C("low") + 1).alias("place"))


@query("zslab_split", f"WITH {PTS}, s AS (SELECT point_id, ntile(4) OVER (ORDER BY z, y, x, point_id) AS slab FROM pts) SELECT slab, count(*) AS points, min(point_id) AS first_id, max(point_id) AS last_id FROM s GROUP BY slab")
def zslab_split(spark, d):
    """Equal contiguous slabs in (z, y, x) order: rows are counted by plane, then a row's place gives its slab."""
    p = pts(spark, d)
    n = p.groupBy("z").count()
    before = n.select("z", (F.sum("count").over(Window.orderBy("z")) - C("count")).alias("before"), F.sum("count").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("z").orderBy("y", "x", "point_id"))).join(F.broadcast(before), "z")
    place, size, extra = C("before") + C("n") - 1, F.floor(C("total") / 4), C("total") % 4
    slab = F.when(place < extra * (size + 1), F.floor(place / (size + 1))).otherwise(extra + F.floor((place - extra * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return p.select("point_id", slab.cast("int").alias("slab")).groupBy("slab").agg(F.count(F.lit(1)).alias("points"), F.min("point_id").alias("first_id"), F.max("point_id").alias("last_id"))


@query("progress", f"WITH {PTS} SELECT point_id, concat(row_number() OVER (ORDER BY sqrt((x-80)*(x-80) + (y-80)*(y-80) + (z-40)*(z-40)), point_id), '/', count(*) OVER ()) AS line FROM pts")
def progress(spark, d):
    p = processing_order(spark, d)
    return p.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))).select("point_id", F.concat_ws("/", C("place").cast("string"), C("n").cast("string")).alias("line"))


@query("grid_in_mask", """WITH l AS (SELECT CAST(s_suppkey AS BIGINT) AS k, radians(s_suppkey % 90) AS t, a.i * 10.0::DOUBLE AS gx, b.i * 10.0::DOUBLE AS gy, c.i * 12.0::DOUBLE AS gz FROM supplier, range(-5, 6) a(i), range(-5, 6) b(i), range(-5, 6) c(i)),
r AS (SELECT k, gx * cos(t) - gy * sin(t) + 29.5 AS x, gx * sin(t) + gy * cos(t) + 29.5 AS y, gz + 39.5 AS z FROM l)
SELECT k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM r WHERE x BETWEEN -1e-9 AND 59 + 1e-9 AND y BETWEEN -1e-9 AND 59 + 1e-9 AND z BETWEEN -1e-9 AND 79 + 1e-9""")
def grid_in_mask(spark, d):
    """Lattices through a volume's centre, turned about z by an angle for each supplier, where they lie inside."""
    from corrvox.functions.geometry import apply, lattice_rotation
    from corrvox.plans.cases import lattices

    k = C("s_suppkey").cast("long")
    ends = [F.lit(float(v)).alias(f"{e}_{a}") for e, v in (("lo", -5), ("hi", 5)) for a in "xyz"]
    turn = lattice_rotation((F.lit(0.0), F.lit(0.0), (k % 90).cast("double")))
    # A supplier's matrix is made before its lattice is, not at each point.
    m = [turn[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    g = lattices(dealt(table(spark, d, "supplier").select(k.alias("k"), *m)).select("*", *ends, F.lit(1.0).alias("spacing")))
    p = apply([[C(f"m{i}{j}") for j in range(3)] for i in range(3)], (10.0 * C("x"), 10.0 * C("y"), 12.0 * C("z")))
    g = g.select("k", *[(v + c).alias(a) for a, v, c in zip("xyz", p, (29.5, 29.5, 39.5), strict=True)])
    inside = F.lit(True)
    for a, n in zip("xyz", (59, 59, 79), strict=True):
        inside = inside & C(a).between(-1e-9, n + 1e-9)
    return g.where(inside).select("k", *[rd(C(a), 6).alias(a) for a in "xyz"])
