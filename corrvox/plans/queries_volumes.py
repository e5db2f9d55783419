"""Volumes that are made from ``events``, stored as zarr and read by box; masks and crops of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corrvox.operators import crop, masks
from corrvox.operators.tables import cut, shared_dir, written
from corrvox.plans.fixtures import table
from corrvox.plans.registry import query
from corrvox.sources import volume_sink, volumes

C = F.col
NX, NY, BRICK = 40, 32, 8
VOX = f"vox AS (SELECT event_id % {NX} AS x, (event_id // {NX}) % {NY} AS y, event_id // {NX * NY} AS z, CAST(round(value * 10) AS BIGINT) % 1000 AS v FROM events)"

# All voxels of the stored volume: the last layer is filled up with zeros.
WHOLE = f"{VOX}, d AS (SELECT max(z) AS top FROM vox), w AS (SELECT x.i AS x, y.i AS y, z.i AS z, coalesce(v, 0) AS v FROM d, range({NX}) x(i), range({NY}) y(i), range((SELECT top + 1 FROM d)) z(i) LEFT JOIN vox ON vox.x = x.i AND vox.y = y.i AND vox.z = z.i)"


def vox(spark, d):
    """A voxel for each event, layer on layer."""
    e = C("event_id").cast("long")
    place = [(e % NX).alias("x"), (F.floor(e / NX) % NY).alias("y"), F.floor(e / (NX * NY)).alias("z")]
    return table(spark, d, "events").select(*[p.cast("int") for p in place], (F.round(C("value") * 10).cast("long") % 1000).alias("v")).toDF("x", "y", "z", "v")


def stored(spark, d, levels: int = 1) -> str:
    """The volume as an OME-Zarr image in the shared folder."""
    v = vox(spark, d)
    shape = (NX, NY, v.agg(F.max("z")).first()[0] + 1)
    path = written(spark, f"{shared_dir(spark)}/corrvox-{uuid.uuid4().hex}.zarr")
    volume_sink.write_zarr(volumes.bricks_of_voxels(v, shape, BRICK, "<u2"), shape, "<u2", BRICK, path, 4, levels=levels)
    return path


@query("volume_box", f"WITH {VOX} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST(v AS DOUBLE) AS v FROM vox WHERE x BETWEEN 5 AND 29 AND y BETWEEN 3 AND 16")
def volume_box(spark, d):
    """A box of a stored volume: the source opens only the bricks it touches."""
    path = stored(spark, d)
    depth = volumes.layout(path, {})["shape"][2]
    lo, hi = (5, 3, 0), (30, 17, depth)
    box = volumes.in_box(volumes.read_bricks(spark, path, BRICK), lo, hi, BRICK)
    # The last layer is filled up with zeros where there are no events.
    return volumes.voxel_rows(box, BRICK, lo, hi).join(vox(spark, d).select("x", "y", "z"), ["x", "y", "z"], "left_semi")


@query("volume_levels", f"WITH {WHOLE}, a AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round_even(avg(v), 0) AS v FROM w GROUP BY ALL) SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, round_even(avg(v), 0) AS v FROM a GROUP BY ALL")
def volume_levels(spark, d):
    """The third level of a pyramid: rounded means of blocks of rounded means of blocks."""
    return volumes.voxel_rows(volumes.read_bricks(spark, stored(spark, d, 3), BRICK, level="2"), BRICK)


_SUB = f"""WITH {WHOLE}, s AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, v FROM w WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0),
r AS (SELECT min(v) AS lo, greatest(max(v) - min(v), 1e-300) AS width, least(4, max(z) + 1) AS deep FROM s),
h AS (SELECT least(floor((v - lo) / width::DOUBLE * 256), 255) AS bin, count(*) AS n FROM s, r GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * (bin + 0.5::DOUBLE)) OVER (ORDER BY bin) AS m, sum(n) OVER () AS wt, sum(n * (bin + 0.5::DOUBLE)) OVER () AS mt FROM h),
t AS (SELECT lo + bin * width / 256::DOUBLE AS threshold FROM c, r ORDER BY round(pow(mt * w - m * wt, 2) / greatest(w::DOUBLE * (wt - w), 1), 3) DESC, bin LIMIT 1),
f AS (SELECT x, y, z, CAST(v > threshold AS BIGINT) AS n FROM s, t),
fx AS (SELECT x, y, z, sum(n) OVER (PARTITION BY y, z ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM f),
fy AS (SELECT x, y, z, sum(n) OVER (PARTITION BY x, z ORDER BY y ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM fx),
fz AS (SELECT x, y, z, sum(n) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM fy)
SELECT CAST(least(2 * x, {NX - 8}) AS BIGINT) AS x, CAST(least(2 * y, {NY - 8}) AS BIGINT) AS y, CAST(least(2 * z, greatest((SELECT top + 1 FROM d) - 8, 0)) AS BIGINT) AS z, CAST(n AS BIGINT) AS n, threshold
FROM fz, r, t WHERE x <= {NX // 2 - 4} AND y <= {NY // 2 - 4} AND z <= (SELECT max(z) + 1 FROM s) - deep ORDER BY n DESC, z, y, x LIMIT 1"""


@query("otsu_crop", _SUB)
def otsu_crop(spark, d):
    """The cube of side 8 with the most foreground, from every second voxel."""
    path = stored(spark, d)
    return crop.choose_crop(volumes.read_bricks(spark, path, BRICK), tuple(volumes.layout(path, {})["shape"]), BRICK, 8, 2)


_PARTS = f"""WITH RECURSIVE {VOX}, m AS (SELECT z * {NX * NY} + y * {NX} + x AS id, x, y, z FROM vox WHERE v % 10 < 2),
n AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.id IN (a.id - {NX * NY}, a.id - {NX}, a.id - 1, a.id + 1, a.id + {NX}, a.id + {NX * NY})),
r AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.b)
SELECT CAST(m.x AS INT) AS x, CAST(m.y AS INT) AS y, CAST(m.z AS INT) AS z, CAST(min(r.b) AS BIGINT) AS part, count(*) AS voxels FROM m JOIN r ON r.a = m.id GROUP BY m.x, m.y, m.z"""


@query("mask_parts", _PARTS)
def mask_parts(spark, d):
    """Voxels of a mask made from events with the first voxel and the size of the part they are connected with."""
    v = vox(spark, d)
    shape = (NX, NY, v.agg(F.max("z")).first()[0] + 1)
    mask = cut(volumes.bricks_of_voxels(v.where("v % 10 < 2").select("x", "y", "z", F.lit(1).alias("v")), shape, BRICK, "u1"))
    named = cut(masks.parts(mask, shape, BRICK, cut).select("label", "part"))
    at = volumes.voxel_rows(masks.label_bricks(mask, shape, BRICK), BRICK).where("v >= 0").select("x", "y", "z", C("v").cast("long").alias("label")).join(named, "label")
    own = at.groupBy("part").agg(F.min((C("z").cast("long") * NY + C("y")) * NX + C("x")).alias("first"), F.count(F.lit(1)).alias("voxels"))
    return at.join(own, "part").select("x", "y", "z", C("first").alias("part"), "voxels")
