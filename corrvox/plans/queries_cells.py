"""Point clouds stored by cells: boxes, counts from the index, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corrvox.operators.tables import shared_dir, written
from corrvox.plans.fixtures import PTS, pts
from corrvox.plans.queries_plan import CLUSTERED, clustered
from corrvox.plans.registry import query
from corrvox.sources import cells

C = F.col


def _stored(spark, points, cell: float) -> str:
    path = written(spark, f"{shared_dir(spark)}/corrvox-{uuid.uuid4().hex}")
    for part in (0, 1):  # two appends: a cell's rows lie in files of both
        cells.append(points.where(C("point_id") % 2 == part), path, cell, 8)
    return path


@query("store_box", f"WITH {CLUSTERED} SELECT point_id, x, y, z FROM cloud WHERE x >= 380 AND x < 431 AND y >= 90 AND y < 300 AND z >= 290 AND z < 400")
def store_box(spark, d):
    """A box of a stored cloud: only files and row groups with its cells are read."""
    return cells.read_box(spark, _stored(spark, clustered(spark, d), 16.0), (380.0, 90.0, 290.0), (431.0, 300.0, 400.0))


@query("store_all", f"WITH {PTS} SELECT point_id, x, y, z FROM pts")
def store_all(spark, d):
    return cells.read_all(spark, _stored(spark, pts(spark, d), 64.0))


@query("store_cells", f"WITH {CLUSTERED} SELECT CAST(floor(x / 16) AS BIGINT) AS cx, CAST(floor(y / 16) AS BIGINT) AS cy, CAST(floor(z / 16) AS BIGINT) AS cz, count(*)::BIGINT AS points, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi FROM cloud GROUP BY 1, 2, 3")
def store_cells(spark, d):
    """Counts and extents of cells, from the index alone."""
    return cells.cell_counts(spark, _stored(spark, clustered(spark, d), 16.0))


@query("stored_bins", f"WITH {CLUSTERED} SELECT 'sound' AS state, count(*) AS points, count(DISTINCT (floor(x / 16), floor(y / 16), floor(z / 16))) AS cells FROM cloud")
def stored_bins(spark, d):
    """The files of a stored cloud held against its index."""
    path = _stored(spark, clustered(spark, d), 16.0)
    bad = cells.problems(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("bad"))
    held = cells.index(spark, path).agg(F.sum("points").alias("points"), F.count_distinct("code").alias("cells"))
    return held.join(F.broadcast(bad)).select(F.when(C("bad") == 0, "sound").otherwise("damaged").alias("state"), "points", "cells")
