"""Order of solving and starting displacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.operators.knn import inverse_distance, near_lists

C = F.col


def with_distance(points: DataFrame, start: tuple[float, float, float]) -> DataFrame:
    d = [C(a) - float(s) for a, s in zip("xyz", start, strict=True)]
    return points.withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def wavefront_shells(points: DataFrame, start: tuple[float, float, float], width: float) -> DataFrame:
    """shell of every point: the nearest point alone is shell 0, the others follow by floor(distance / width), numbered without gaps."""
    if width <= 0:
        raise ValueError("the shell width must be positive")
    p = with_distance(points, start)
    first = p.agg(F.min_by("point_id", F.struct("distance", "point_id")).alias("first_id"))  # one row
    p = p.join(F.broadcast(first)).withColumn("ring", F.when(C("point_id") == C("first_id"), -1).otherwise(F.floor(C("distance") / width)))
    rings = p.select("ring").distinct()
    # Rings are few (the extent over the width); they are numbered in one window.
    named = rings.withColumn("shell", (F.row_number().over(Window.orderBy("ring")) - 1).cast("int"))
    return p.join(F.broadcast(named), "ring").drop("ring", "first_id")


def coarse_subset(points: DataFrame, stride: int, spacing: float) -> DataFrame:
    """The point nearest the lower corner of each cube of stride x spacing."""
    if stride <= 1:
        return points
    step = stride * spacing
    low = points.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"])  # one row
    p = points.join(F.broadcast(low))
    rel = {a: (C(a) - C(f"lo_{a}")) / step for a in "xyz"}
    p = p.select(*points.columns, *[F.floor(r + 1e-9).cast("long").alias(f"k{a}") for a, r in rel.items()], *[r.alias(f"r{a}") for a, r in rel.items()])
    d = [C(f"r{a}") - C(f"k{a}") for a in "xyz"]
    corner = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    best = F.min_by(F.struct(*points.columns), F.struct(F.round(corner, 12), C("point_id"))).alias("p")
    return p.groupBy("kx", "ky", "kz").agg(best).select("p.*")


def seed_from_neighbours(edges: DataFrame, solved: DataFrame, rigid: tuple[float, float, float], points: DataFrame) -> DataFrame:
    """su, sv, sw of ``points``: the mean of their GOOD solved neighbours, else ``rigid``.

    ``edges``: (point_id, neighbour_id); ``solved``: (point_id, status, u, v, w).
    """
    good = solved.where("status = 0").select(C("point_id").alias("neighbour_id"), "u", "v", "w")
    mean = edges.join(good, "neighbour_id").groupBy("point_id").agg(*[F.avg(c).alias(f"s{c}") for c in "uvw"])
    return points.select("point_id").join(mean, "point_id", "left").select("point_id", *[F.coalesce(f"s{c}", F.lit(float(r))).alias(f"s{c}") for c, r in zip("uvw", rigid, strict=True)])


def interpolate_seeds(points: DataFrame, coarse: DataFrame, k: int, cell: float, fallback: tuple[float, float, float]) -> DataFrame:
    """Seeds of ``points`` from the ``k`` nearest GOOD coarse points by inverse squared distance."""
    good = coarse.where("status = 0")
    near = near_lists(points, good, k, cell, with_self=True, carry=("u", "v", "w"))
    mean = inverse_distance(near, ("u", "v", "w"))
    return points.select("point_id").join(mean, "point_id", "left").select("point_id", *[F.coalesce(c, F.lit(float(f))).alias(f"s{c}") for c, f in zip("uvw", fallback, strict=True)])


def lookup_seeds(points: DataFrame, field: DataFrame, rigid: tuple[float, float, float]) -> DataFrame:
    """Seeds of a stored field by id (point_id, su, sv, sw); ``rigid`` where it has none."""
    return points.join(field, "point_id", "left").select(*points.columns, *[F.coalesce(f"s{c}", F.lit(float(r))).alias(f"s{c}") for c, r in zip("uvw", rigid, strict=True)])
