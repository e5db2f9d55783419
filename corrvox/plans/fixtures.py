"""Relations derived from the bundled tables, and the same as SQL common table expressions.

The tables hold no image volumes and no point clouds; these recipes make them from ``events``,
``embeddings`` and ``part`` with dyadic arithmetic, so both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrvox.operators.tables import shuffles


#: A task sorts so many rows at most, so its memory doesn't grow with the table.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rd(col, digits: int = 9):
    """Rounded, with one zero (no minus zero)."""
    return F.round(col, digits) + F.lit(0.0)


def div(a, b: int):
    """Whole-number division of non-negative longs."""
    return F.floor(a / F.lit(b)).cast("long")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of search points with spacing 8, one for each event."""
    e = F.col("event_id").cast("long")
    return table(spark, sf_dir, "events").select(
        e.alias("point_id"),
        (F.lit(8.0) * (e % 20)).alias("x"),
        (F.lit(8.0) * (div(e, 20) % 20)).alias("y"),
        (F.lit(8.0) * div(e, 400)).alias("z"),
    )


def truth(points: DataFrame, *more: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.select(
        "point_id", "x", "y", "z", *more,
        (F.lit(1.25) + x / 64 - y / 128).alias("u"),
        (F.lit(-0.5) + z / 256).alias("v"),
        (F.lit(0.25) + (x + y) / 512).alias("w"),
    )


def _result(spark: SparkSession, sf_dir: str, error, status) -> DataFrame:
    """Results made from the events, one for each pair of an event's point and its error (so those of an identifier that
    repeats n times are n times n). A point follows from the identifier, so nothing is joined: rows are counted by identifier."""
    i = F.col("event_id").cast("long")
    events = table(spark, sf_dir, "events")
    e = events.where("event_id IS NOT NULL").select(
        i.alias("point_id"), (F.lit(8.0) * (i % 20)).alias("x"), (F.lit(8.0) * (div(i, 20) % 20)).alias("y"), (F.lit(8.0) * div(i, 400)).alias("z"),
        error.alias("e"), status.cast("int").alias("status"),
    )
    n = -(-events.count() // TASK_ROWS)  # from the files' footers
    if n > shuffles(spark):
        e = e.repartition(n, "point_id")
    same = F.count(F.lit(1)).over(Window.partitionBy("point_id"))
    t = truth(e.withColumn("n", same).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), "e", "status")
    return t.select(
        "point_id", "x", "y", "z", "status",
        (F.abs("e") + (F.col("point_id") % 7) / 64).alias("objmin"),
        (F.col("u") + F.col("e")).alias("u"),
        (F.col("v") - F.col("e") / 2).alias("v"),
        (F.col("w") + F.col("e") / 4).alias("w"),
    )


def res_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = (F.round(F.col("value") * 100).cast("long") % 101 - 50) / F.lit(1024.0)
    status = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "signup", -2).otherwise(0)
    return _result(spark, sf_dir, error, status)


def res_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("long")
    return _result(spark, sf_dir, ((e * 7919) % 97 - 48) / F.lit(2048.0), F.when(e % 37 == 0, -3).when(e % 11 == 0, -1).otherwise(0))


def res_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("long")
    return _result(spark, sf_dir, ((e * 104729) % 89 - 44) / F.lit(2048.0), F.when(e % 41 == 0, -4).otherwise(0))


def subvol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors of 64 samples for each embedding that has its four successors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    out = v
    for k, name in enumerate(("g", "gx", "gy", "gz"), 1):
        out = out.join(v.select((F.col("vec_id") - k).alias("vec_id"), F.col("f").alias(name)), "vec_id")
    return out


def stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 taps (z, y, x order) and a fractional place for each embedding."""
    i = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("taps"),
        ((i % 16) / 16).alias("tx"), (((i * 5) % 16) / 16).alias("ty"), (((i * 11) % 16) / 16).alias("tz"),
    )


def evlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker event log: one read, solve, write or wait for each event."""
    e = F.col("event_id").cast("long")
    kind = F.col("event_type")
    ev = F.when(kind == "purchase", "solve").when(kind == "view", "read").when(kind == "click", "write").when(kind == "signup", "wait_read").otherwise("wait_write")
    t0 = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("int").alias("worker"), ev.alias("ev"), (e % 64).alias("tile"),
        t0.alias("t0"), (t0 + F.col("value")).alias("t1"), (e % 50 + 1).alias("points"), (e % 1000 * 4096).alias("bytes"),
    )


PTS = "pts AS (SELECT CAST(event_id AS BIGINT) AS point_id, 8.0::DOUBLE * (event_id % 20) AS x, 8.0::DOUBLE * ((event_id // 20) % 20) AS y, 8.0::DOUBLE * (event_id // 400) AS z FROM events)"
TRUTH = PTS + ",\ntruth AS (SELECT point_id, x, y, z, 1.25::DOUBLE + x / 64 - y / 128 AS u, -0.5::DOUBLE + z / 256 AS v, 0.25::DOUBLE + (x + y) / 512 AS w FROM pts)"


def _res(name: str, error: str, status: str) -> str:
    return (
        f"{name} AS (SELECT t.point_id, x, y, z, status, abs(e) + (t.point_id % 7) / 64.0::DOUBLE AS objmin, u + e AS u, v - e / 2 AS v, w + e / 4 AS w "
        f"FROM truth t JOIN (SELECT CAST(event_id AS BIGINT) AS point_id, {error} AS e, CAST({status} AS INT) AS status FROM events) USING (point_id))"
    )


RES_A = _res("res_a", "(CAST(round(value * 100) AS BIGINT) % 101 - 50) / 1024.0::DOUBLE", "CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'signup' THEN -2 ELSE 0 END")
RES_B = _res("res_b", "((CAST(event_id AS BIGINT) * 7919) % 97 - 48) / 2048.0::DOUBLE", "CASE WHEN event_id % 37 = 0 THEN -3 WHEN event_id % 11 = 0 THEN -1 ELSE 0 END")
RES_C = _res("res_c", "((CAST(event_id AS BIGINT) * 104729) % 89 - 44) / 2048.0::DOUBLE", "CASE WHEN event_id % 41 = 0 THEN -4 ELSE 0 END")
RESULTS = f"{TRUTH},\n{RES_A},\n{RES_B},\n{RES_C}"
SUBVOL = (
    "emb AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS f FROM embeddings),\n"
    "subvol AS (SELECT a.vec_id, a.f, b.f AS g, c.f AS gx, d.f AS gy, e.f AS gz FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 JOIN emb c ON c.vec_id = a.vec_id + 2 JOIN emb d ON d.vec_id = a.vec_id + 3 JOIN emb e ON e.vec_id = a.vec_id + 4),\n"
    "samp AS (SELECT vec_id, unnest(f) AS f, unnest(g) AS g, unnest(gx) AS gx, unnest(gy) AS gy, unnest(gz) AS gz, generate_subscripts(f, 1) AS i FROM subvol)"
)
STENCIL = "stencil AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS taps, (vec_id % 16) / 16.0::DOUBLE AS tx, ((vec_id * 5) % 16) / 16.0::DOUBLE AS ty, ((vec_id * 11) % 16) / 16.0::DOUBLE AS tz FROM embeddings)"
EVLOG = (
    "evlog AS (SELECT CAST(user_id % 4 AS INT) AS worker, CASE event_type WHEN 'purchase' THEN 'solve' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'wait_read' ELSE 'wait_write' END AS ev, "
    "CAST(event_id % 64 AS BIGINT) AS tile, epoch_us(ts) / 1e6 AS t0, epoch_us(ts) / 1e6 + value AS t1, CAST(event_id % 50 + 1 AS BIGINT) AS points, CAST(event_id % 1000 * 4096 AS BIGINT) AS bytes FROM events)"
)
