"""Planning, sharing out, resuming and finishing runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrvox.operators import digests, kdtree, tiling
from corrvox.operators.tables import cut
from corrvox.plans.fixtures import PTS, RESULTS, TRUTH, pts, rd, res_a, res_b, table, truth
from corrvox.plans.registry import query

C = F.col
_TILE = "CAST(floor(x / 64) AS INT) AS tx, CAST(floor(y / 64) AS INT) AS ty, CAST(floor(z / 64) AS INT) AS tz"


def _seeded(spark, d):
    return truth(pts(spark, d)).select("point_id", "x", "y", "z", *[C(c).alias(f"s{c}") for c in "uvw"])


_ONE = f"p AS (SELECT *, {_TILE} FROM truth), m AS (SELECT tx, ty, tz, count(*) AS n_points, min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my, min(z) AS nz, max(z) AS mz, quantile_cont(u, 0.5) AS cu, quantile_cont(v, 0.5) AS cv, quantile_cont(w, 0.5) AS cw FROM p GROUP BY ALL), s AS (SELECT p.tx, p.ty, p.tz, max(abs(u - cu)) AS su, max(abs(v - cv)) AS sv, max(abs(w - cw)) AS sw FROM p JOIN m USING (tx, ty, tz) GROUP BY ALL), t AS (SELECT * FROM m JOIN s USING (tx, ty, tz)), b AS (SELECT tx, ty, tz, n_points, " + ", ".join(
    f"CAST(ceil(n{a}) - 18 AS BIGINT) AS ref_{a}_lo, CAST(floor(m{a}) + 1 + 18 AS BIGINT) AS ref_{a}_hi, CAST(floor(ceil(n{a}) - 18 + c{u}) - ceil(s{u}) AS BIGINT) AS def_{a}_lo, CAST(ceil(floor(m{a}) + 1 + 18 + c{u}) + ceil(s{u}) AS BIGINT) AS def_{a}_hi" for a, u in zip("xyz", "uvw", strict=True)) + ", n_points * 1500.0::DOUBLE AS cost FROM t)"


@query("tile_plan", f"WITH {TRUTH}, {_ONE} SELECT * FROM b")
def tile_plan(spark, d):
    return tiling.plan(_seeded(spark, d), 64.0, 17.5, 1500.0)


@query("tile_bricks", f"WITH {TRUTH}, {_ONE}, k(i) AS (SELECT unnest(range(0, 8))) SELECT tx, ty, tz, CAST(x.i AS INT) AS bx, CAST(y.i AS INT) AS by, CAST(z.i AS INT) AS bz FROM b, k x, k y, k z WHERE " + " AND ".join(f"{a}.i >= greatest(ref_{a}_lo, 0) // 32 AND {a}.i <= (least(ref_{a}_hi, {n}) - 1) // 32" for a, n in zip("xyz", (160, 160, 208), strict=True)))
def tile_bricks(spark, d):
    p = tiling.plan(_seeded(spark, d), 64.0, 17.5, 1500.0)
    return tiling.bricks_of(p, 32, "ref", (160, 160, 208)).select("tx", "ty", "tz", "bx", "by", "bz")


@query("largest_task", f"WITH {TRUTH}, {_ONE} SELECT tx, ty, tz, n_points, ((ref_x_hi - ref_x_lo) * (ref_y_hi - ref_y_lo) * (ref_z_hi - ref_z_lo) + (def_x_hi - def_x_lo) * (def_y_hi - def_y_lo) * (def_z_hi - def_z_lo)) * 8.0::DOUBLE AS bytes FROM b ORDER BY bytes DESC, tx DESC, ty DESC, tz DESC LIMIT 1")
def largest_task(spark, d):
    """The tile whose images take most memory, what a run is refused by."""
    return tiling.largest_task(tiling.plan(_seeded(spark, d), 64.0, 17.5, 1500.0), 8)


# A cloud of which a third lies in one 48th of its length.
CLUSTERED = "cloud AS (SELECT CAST(event_id AS BIGINT) AS point_id, CASE WHEN event_id % 3 = 0 THEN 400 + (event_id * 7) % 20 ELSE (event_id * 37) % 960 END * 1.0::DOUBLE AS x, CASE WHEN event_id % 3 = 0 THEN 100 + (event_id * 11) % 25 ELSE (event_id * 53) % 640 END * 1.0::DOUBLE AS y, CASE WHEN event_id % 3 = 0 THEN 300 + user_id % 30 ELSE (user_id * 5) % 480 END * 1.0::DOUBLE AS z FROM events)"


def clustered(spark, d):
    e, u = C("event_id").cast("long"), C("user_id").cast("long")
    x, y, z = [F.when(e % 3 == 0, dense).otherwise(wide).cast("double") for dense, wide in ((400 + (e * 7) % 20, (e * 37) % 960), (100 + (e * 11) % 25, (e * 53) % 640), (300 + u % 30, (u * 5) % 480))]
    return table(spark, d, "events").select(e.alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"))


_KD = f"""WITH RECURSIVE {CLUSTERED}, c0 AS (SELECT CAST(floor(x / 4) AS INT) AS cx, CAST(floor(y / 4) AS INT) AS cy, CAST(floor(z / 4) AS INT) AS cz, count(*) AS n FROM cloud GROUP BY ALL),
t AS (SELECT cx, cy, cz, n, CAST(1 AS BIGINT) AS node, true AS open FROM c0
UNION ALL SELECT cx, cy, cz, n, CASE WHEN axis IS NULL THEN node WHEN place > mid THEN 2 * node + 1 ELSE 2 * node END, axis IS NOT NULL FROM (
  SELECT *, coalesce(min(CASE WHEN place < last AND 2 * upto >= size THEN place END) OVER (PARTITION BY node), max(CASE WHEN place < last THEN place END) OVER (PARTITION BY node)) AS mid FROM (
  SELECT *, sum(n) OVER (PARTITION BY node ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(place) OVER (PARTITION BY node) AS last FROM (
  SELECT *, CASE axis WHEN 0 THEN cx WHEN 1 THEN cy WHEN 2 THEN cz END AS place FROM (
  SELECT *, CASE WHEN greatest(sx, sy, sz) > 0 AND (size > 100 OR greatest(sx, sy, sz) + 1 > 256) THEN CASE greatest(sx, sy, sz) WHEN sx THEN 0 WHEN sy THEN 1 ELSE 2 END END AS axis FROM (
  SELECT *, sum(n) OVER w AS size, max(cx) OVER w - min(cx) OVER w AS sx, max(cy) OVER w - min(cy) OVER w AS sy, max(cz) OVER w - min(cz) OVER w AS sz FROM t WHERE open WINDOW w AS (PARTITION BY node)))))))
SELECT node AS leaf, sum(n)::BIGINT AS n_points, min(cx) AS lo_x, max(cx) AS hi_x, min(cy) AS lo_y, max(cy) AS hi_y, min(cz) AS lo_z, max(cz) AS hi_z FROM t WHERE NOT open GROUP BY node"""


@query("kd_tiles", _KD)
def kd_tiles(spark, d):
    """Leaves of 100 points at most (or one cell) of a clustered cloud, none longer than 1024."""
    cells = kdtree.kd_cells(clustered(spark, d), 100, 4.0, 1024.0, cut)
    ends = [f(f"c{a}").alias(f"{e}_{a}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]
    return cells.groupBy("leaf").agg(F.sum("n").alias("n_points"), *ends)


def _tiles(spark, d):
    t = tiling.tile_of(pts(spark, d), 64.0)
    return t.groupBy((C("tz") * 100 + C("ty") * 10 + C("tx")).cast("long").alias("tile_id")).agg(F.count(F.lit(1)).alias("n_points")).withColumn("cost", C("n_points") * (1 + C("tile_id") % 3).cast("double"))


_TILES = f"{PTS}, tiles AS (SELECT CAST(floor(z / 64) * 100 + floor(y / 64) * 10 + floor(x / 64) AS BIGINT) AS tile_id, count(*) AS n_points, count(*) * (1 + CAST(floor(z / 64) * 100 + floor(y / 64) * 10 + floor(x / 64) AS BIGINT) % 3)::DOUBLE AS cost FROM pts GROUP BY tile_id)"
_LPT = f"""WITH RECURSIVE {_TILES}, o AS (SELECT tile_id, cost, row_number() OVER (ORDER BY cost DESC, tile_id) AS n FROM tiles),
a AS (SELECT CAST(0 AS BIGINT) AS n, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS loads, CAST(-1 AS BIGINT) AS tile_id, 0 AS bin UNION ALL
SELECT o.n, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + cost ELSE v END), o.tile_id, CAST(list_position(loads, list_min(loads)) - 1 AS INT) FROM a JOIN o ON o.n = a.n + 1)"""


@query("assign_lpt", f"{_LPT} SELECT tile_id, CAST(bin AS INT) AS bin, round(loads[bin + 1], 6) AS load FROM a WHERE n > 0")
def assign_lpt(spark, d):
    return tiling.assign_lpt(_tiles(spark, d), 4).select("tile_id", "bin", rd(C("load"), 6).alias("load"))


@query("node_share", f"{_LPT} SELECT tile_id FROM a WHERE n > 0 AND bin = 2")
def node_share(spark, d):
    return tiling.assign_lpt(_tiles(spark, d), 4).where("bin = 2").select("tile_id")


@query("weak_scaling_tiles", f"WITH {_TILES} SELECT tile_id, n_points FROM tiles ORDER BY n_points DESC, tile_id LIMIT 8")
def weak_scaling_tiles(spark, d):
    return _tiles(spark, d).orderBy(C("n_points").desc(), "tile_id").limit(8).select("tile_id", "n_points")


@query("resume_tiles", f"WITH {_TILES} SELECT tile_id, n_points FROM tiles ANTI JOIN (SELECT tile_id FROM tiles WHERE tile_id % 2 = 0) w USING (tile_id)")
def resume_tiles(spark, d):
    t = _tiles(spark, d)
    return tiling.remaining(t, t.where("tile_id % 2 = 0").select("tile_id")).select("tile_id", "n_points")


@query("unwritten_cells", f"WITH {_TILES} SELECT tile_id FROM tiles EXCEPT SELECT tile_id FROM tiles WHERE n_points > 300")
def unwritten_cells(spark, d):
    t = _tiles(spark, d)
    return t.select("tile_id").exceptAll(t.where("n_points > 300").select("tile_id"))


@query("finalize", f"WITH {RESULTS} SELECT p.point_id, coalesce(r.status, -3) AS status, round(coalesce(r.u, 0), 9) + 0.0 AS u FROM pts p LEFT JOIN (SELECT * FROM res_b WHERE point_id % 5 <> 0) r USING (point_id)")
def finalize(spark, d):
    done = res_b(spark, d).where("point_id % 5 <> 0")
    return tiling.finalize(done, pts(spark, d), True).select("point_id", "status", rd(C("u")).alias("u"))


@query("write_results_by_tile", f"WITH {RESULTS} SELECT r.point_id, {_TILE.replace('x /', 'r.x /').replace('y /', 'r.y /').replace('z /', 'r.z /')}, r.status FROM res_a r")
def write_results_by_tile(spark, d):
    t = tiling.tile_of(pts(spark, d), 64.0).select("point_id", "tx", "ty", "tz")
    return t.join(res_a(spark, d).select("point_id", "status"), "point_id")


@query("intersect_ids", f"WITH {RESULTS} SELECT point_id FROM res_a WHERE status = 0 INTERSECT SELECT point_id FROM res_b WHERE status = 0")
def intersect_ids(spark, d):
    return res_a(spark, d).where("status = 0").select("point_id").intersect(res_b(spark, d).where("status = 0").select("point_id"))


@query("merge_slabs", f"WITH {RESULTS} SELECT point_id, status FROM res_a WHERE point_id % 2 = 0 UNION ALL SELECT point_id, status FROM res_b WHERE point_id % 2 = 1")
def merge_slabs(spark, d):
    return res_a(spark, d).where("point_id % 2 = 0").select("point_id", "status").unionByName(res_b(spark, d).where("point_id % 2 = 1").select("point_id", "status"))


@query("effective_samples", "SELECT p_partkey, 1 + p_partkey % 5000 AS asked, CASE WHEN p_partkey % 2 = 0 THEN (SELECT min(k * k * k) FROM range(1, 20) r(k) WHERE k * k * k >= 1 + p_partkey % 5000) ELSE 1 + p_partkey % 5000 END AS samples FROM part")
def effective_samples(spark, d):
    """A cube template rounds its samples up to a cube number; whole numbers only."""
    n = (1 + C("p_partkey") % 5000).cast("long")
    cube = F.array_min(F.filter(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(19).cast("long")), lambda k: k * k * k), lambda c: c >= n))
    return table(spark, d, "part").select("p_partkey", n.alias("asked"), F.when(C("p_partkey") % 2 == 0, cube).otherwise(n).alias("samples"))


@query("flops", "SELECT p_partkey, CAST(p_size * 1000 * (64 * 3 + (CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END) * ((CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 12 END) + 1) + 40) AS BIGINT) AS flops FROM part")
def flops(spark, d):
    """Operations of one iteration: taps, products of the Jacobian, and the rest, for each sample."""
    dof = F.when(C("p_partkey") % 3 == 0, 3).when(C("p_partkey") % 3 == 1, 6).otherwise(12)
    return table(spark, d, "part").select("p_partkey", (C("p_size") * 1000 * (64 * 3 + dof * (dof + 1) + 40)).cast("long").alias("flops"))


@query("fingerprint_diff", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), kv AS (SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM k), b AS (SELECT event_id - 1 AS event_id, key, value FROM kv WHERE event_id > 0) SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.key, b.key) AS key, a.value AS was, b.value AS now FROM kv a FULL JOIN b ON a.event_id = b.event_id AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def fingerprint_diff(spark, d):
    """Keys of consecutive settings documents that differ: flattened to rows and joined in full."""
    kv = table(spark, d, "events").select(C("event_id").cast("long").alias("event_id"), F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    a, b = kv.withColumnRenamed("value", "was"), kv.where("event_id > 0").select((C("event_id") - 1).alias("event_id"), "key", C("value").alias("now"))
    return a.join(b, ["event_id", "key"], "full_outer").where(~C("was").eqNullSafe(C("now")))


_NODE = "SELECT key // {n} AS key, sha256(string_agg(key || ':' || digest, ';' ORDER BY key)) AS digest FROM {t} GROUP BY key // {n}"


@query("points_digest", f"""WITH RECURSIVE r AS (SELECT event_id::BIGINT AS key, sha256('{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}') AS digest FROM events),
l AS ({_NODE.format(n=1024, t='r')}), t AS (SELECT key, digest, 0 AS lev, (SELECT count(*) FROM l) AS n FROM l
UNION ALL SELECT key // 64, sha256(string_agg(key || ':' || digest, ';' ORDER BY key)), lev + 1, count(*) OVER () FROM t WHERE n > 1 GROUP BY key // 64, lev) SELECT digest FROM t WHERE n = 1""")
def points_digest(spark, d):
    """A digest of a table by its key, the same for any partitioning."""
    return digests.table_digest(table(spark, d, "events"), "event_id", ["user_id", "event_type"])


@query("run_fingerprint", "SELECT event_id, substr(sha256(concat(event_type, '|', user_id, '|', CAST(event_id AS VARCHAR))), 1, 16) AS digest FROM events")
def run_fingerprint(spark, d):
    return table(spark, d, "events").select("event_id", F.substring(F.sha2(F.concat_ws("|", "event_type", C("user_id").cast("string"), C("event_id").cast("string")), 256), 1, 16).alias("digest"))


@query("points_in_mask", f"WITH {TRUTH}, mask AS (SELECT DISTINCT CAST(round_even((x + u) / 16, 0) AS BIGINT) AS mx, CAST(round_even((y + v) / 16, 0) AS BIGINT) AS my, CAST(round_even((z + w) / 16, 0) AS BIGINT) AS mz FROM truth WHERE point_id % 3 = 0) SELECT point_id FROM (SELECT point_id, CAST(round_even(x / 16, 0) AS BIGINT) AS mx, CAST(round_even(y / 16, 0) AS BIGINT) AS my, CAST(round_even(z / 16, 0) AS BIGINT) AS mz FROM truth) p SEMI JOIN mask USING (mx, my, mz)")
def points_in_mask(spark, d):
    """Points whose nearest mask voxel is set: an equi-join on the rounded voxel."""
    t = truth(pts(spark, d))
    vox = lambda cols: [F.rint(c / 16).cast("long").alias(f"m{a}") for a, c in zip("xyz", cols, strict=True)]
    mask = t.where("point_id % 3 = 0").select(*vox([C(a) + C(u) for a, u in zip("xyz", "uvw", strict=True)])).distinct()
    return t.select("point_id", *vox([C(a) for a in "xyz"])).join(mask, ["mx", "my", "mz"], "left_semi").select("point_id")
