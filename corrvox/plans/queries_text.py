"""Text formats: lines are built from tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrvox.plans.fixtures import PTS, RESULTS, pts, rd, res_a, table
from corrvox.plans.registry import query
from corrvox.sources import text

C = F.col


def _roi(spark, d):
    """Lines with a header, comments and mixed separators."""
    e = C("point_id")
    sep = F.when(e % 3 == 0, "\t").when(e % 3 == 1, " ").otherwise(",")
    line = F.concat(*[x for c in ("point_id", "x", "y", "z") for x in (C(c).cast("string"), sep)])
    line = F.concat(F.regexp_replace(line, "[\t ,]$", ""), F.when(e % 5 == 0, "  # note").otherwise(""))
    rows = pts(spark, d).select((e + 2).alias("line_no"), line.alias("line"))
    return rows.unionByName(spark.createDataFrame([(0, "n x y z"), (1, "# cloud")], "line_no long, line string"))


@query("read_roi", f"WITH {PTS} SELECT point_id, x, y, z FROM pts")
def read_roi(spark, d):
    return text.parse_points(_roi(spark, d)).select("point_id", "x", "y", "z")


@query("check_points", f"WITH {PTS} SELECT 'repeated id' AS problem, point_id // 2 AS point_id, count(*) AS count FROM pts WHERE point_id % 7 < 4 GROUP BY point_id // 2 HAVING count(*) > 1")
def check_points(spark, d):
    p = pts(spark, d).where("point_id % 7 < 4").withColumn("point_id", F.floor(C("point_id") / 2).cast("long"))
    return text.point_problems(p)


@query("write_disp", f"WITH {RESULTS} SELECT point_id, concat_ws(chr(9), point_id, printf('%.6f', x), printf('%.6f', y), printf('%.6f', z), greatest(status, -3), printf('%.6f', objmin), printf('%.6f', CASE WHEN status = 0 THEN u ELSE 0 END), printf('%.6f', CASE WHEN status = 0 THEN v ELSE 0 END), printf('%.6f', CASE WHEN status = 0 THEN w ELSE 0 END)) AS line FROM (SELECT point_id, x, y, z, status, round(objmin, 6) AS objmin, round(u, 4) AS u, round(v, 4) AS v, round(w, 4) AS w FROM res_a)")
def write_disp(spark, d):
    r = res_a(spark, d).select("point_id", "x", "y", "z", "status", F.round("objmin", 6).alias("objmin"), *[F.round(c, 4).alias(c) for c in "uvw"])
    return text.result_lines(r)


@query("read_disp", f"WITH {RESULTS} SELECT point_id, x, status, round(u, 4) + 0.0 AS u FROM res_a WHERE status = 0 UNION ALL SELECT point_id, x, greatest(status, -3), 0.0 FROM res_a WHERE status <> 0")
def read_disp(spark, d):
    return text.parse_results(write_disp(spark, d)).select("point_id", "x", "status", rd(C("u"), 4).alias("u"))


@query("write_roi", f"WITH {PTS} SELECT concat_ws(chr(9), point_id, CAST(CAST(x AS BIGINT) AS VARCHAR), CAST(CAST(y AS BIGINT) AS VARCHAR), CAST(CAST(z AS BIGINT) AS VARCHAR)) AS line FROM pts")
def write_roi(spark, d):
    return pts(spark, d).select(F.concat_ws("\t", C("point_id").cast("string"), *[text.significant(C(a)) for a in "xyz"]).alias("line"))


@query("read_dvc_input", "SELECT event_id AS line_no, concat('key_', user_id) AS key, CAST(round(value * 4) AS BIGINT)::VARCHAR || ' a' AS value FROM events WHERE event_id % 9 <> 0")
def read_dvc_input(spark, d):
    e = C("event_id")
    body = F.concat(F.lit("key_"), C("user_id").cast("string"), F.when(e % 2 == 0, "\t").otherwise("  "), F.round(C("value") * 4).cast("long").cast("string"), F.lit(" a"))
    line = F.when(e % 9 == 0, F.concat(F.lit("# "), body)).when(e % 4 == 0, F.concat(body, F.lit(" ### say"))).when(e % 4 == 1, F.concat(body, F.lit("\t# say"))).otherwise(body)
    return text.parse_settings(table(spark, d, "events").select(e.alias("line_no"), line.alias("line"))).select("line_no", "key", "value")


_NUMBERS = " UNION ALL ".join(f"SELECT {1001 + k}, 'number {label} = ' || n{k} || chr(9) || '(' || printf('%.3f', 100.0::DOUBLE * n{k} / total) || '%)' FROM t" for k, label in enumerate(text.NUMBER_LABELS.values()))


@query("write_stat", f"""WITH {RESULTS}, n AS (SELECT status, count(*) AS n FROM res_a GROUP BY status),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, {', '.join(f'CAST(coalesce(sum(n) FILTER (WHERE status = {-k}), 0) AS BIGINT) AS n{k}' for k in range(4))} FROM n)
SELECT -4 AS place, 'run summary' AS line UNION ALL SELECT -3, 'points' || chr(9) || total FROM t UNION ALL SELECT -2, 'seconds' || chr(9) || '8.000' UNION ALL SELECT -1, 'points_per_second' || chr(9) || printf('%.3f', total / 8.0::DOUBLE) FROM t
UNION ALL SELECT -status, 'status ' || (CASE status WHEN 0 THEN 'GOOD' WHEN -1 THEN 'RANGE_FAIL' ELSE 'CONVG_FAIL' END) || chr(9) || n FROM n
UNION ALL SELECT 1000, '' UNION ALL {_NUMBERS} UNION ALL SELECT 1005, '' UNION ALL SELECT 1006, '### config' UNION ALL SELECT 1007, 'dof: 6'""")
def write_stat(spark, d):
    return text.stat_lines(res_a(spark, d), 8.0, "dof: 6")


@query("read_stat_throughput", "SELECT event_id, round(value, 2) AS rate FROM events WHERE event_id % 3 <> 2")
def read_stat_throughput(spark, d):
    v = F.format_string("%.2f", F.round("value", 2))
    line = F.when(C("event_id") % 3 == 0, F.concat(F.lit("points_per_second\t"), v)).when(C("event_id") % 3 == 1, F.concat(F.lit("speed: "), v, F.lit(" pt/sec"))).otherwise(F.lit("no figure"))
    return table(spark, d, "events").select("event_id", text.throughput(line).alias("rate")).where("rate is not null")


@query("props_kv", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM k")
def props_kv(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
