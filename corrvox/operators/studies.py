"""Relations of the studies: parameter sweeps, pairs of results, verdicts, complete cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.functions.geometry import edge_mask
from corrvox.operators import metrics

C = F.col

# Fixed values of the error-floor study: shifts in voxels, directions, variants, noise factors, subvolume sizes, sample numbers.
SHIFTS = tuple(k / 10 for k in range(11))
DIRECTIONS = {"x": (1.0, 0.0, 0.0), "diagonal": (1 / math.sqrt(3),) * 3}
VARIANTS, NOISE_FACTORS, SIZES, N_SAMPLES = ("one-sided", "symmetric"), (0.0, 0.5, 1.0, 2.0), (40.0, 60.0, 80.0), (1000, 2000, 4000, 8000)


def error_floor_cases(spark: SparkSession) -> DataFrame:
    """A row for each combination of the study's parameters (tables of fixed size), with both images' shifts: a symmetric
    case moves each by half."""
    parts = [
        spark.createDataFrame([(s,) for s in SHIFTS], "shift double"),
        spark.createDataFrame([(n, *d) for n, d in DIRECTIONS.items()], "direction string, dx double, dy double, dz double"),
        spark.createDataFrame([(v,) for v in VARIANTS], "variant string"),
        spark.createDataFrame([(n,) for n in NOISE_FACTORS], "noise_factor double"),
        spark.createDataFrame([(s,) for s in SIZES], "size double"),
        spark.createDataFrame([(n,) for n in N_SAMPLES], "n_samples int"),
    ]
    return with_shifts(reduce(lambda a, b: a.join(F.broadcast(b)), parts))


def with_shifts(params: DataFrame) -> DataFrame:
    """Both images' shifts of cases given by shift, direction (dx, dy, dz) and variant."""
    back = F.when(C("variant") == "symmetric", -0.5).otherwise(0.0)
    return params.select(*[c for c in params.columns if c not in ("dx", "dy", "dz")], *[(back * C("shift") * C(f"d{a}")).alias(f"ref_{a}") for a in "xyz"], *[((back + 1) * C("shift") * C(f"d{a}")).alias(f"def_{a}") for a in "xyz"])


def variant_pairs(runs: DataFrame) -> DataFrame:
    """For each two variants (column ``variant``) the points they share: how many, status agreement, GOOD in both, and quantiles
    of the distance of their displacements. A self-join on the point, variants in order, so each pair is met once."""
    a = runs.select("point_id", C("variant").alias("one"), C("status").alias("sa"), *[C(c).alias(f"a{c}") for c in "uvw"])
    b = runs.select("point_id", C("variant").alias("other"), C("status").alias("sb"), *[C(c).alias(f"b{c}") for c in "uvw"])
    j = a.join(b, "point_id").where(C("one") < C("other"))
    d = [C(f"a{c}") - C(f"b{c}") for c in "uvw"]
    both = (C("sa") == 0) & (C("sb") == 0)
    far = F.when(both, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return j.groupBy("one", "other").agg(F.count(F.lit(1)).alias("points"), F.avg((C("sa") == C("sb")).cast("double")).alias("status_agreement"), F.count(far).alias("good_both"), *[F.percentile(far, F.lit(q / 100)).alias(f"p{q}") for q in (50, 95)])


def load_pair(ours: DataFrame, theirs: DataFrame, shape: tuple[int, int, int], reach: float, truth: DataFrame | None = None) -> DataFrame:
    """Both codes' results at the points they share, with ``interior`` (the subvolume stays in the image) and which are GOOD there.

    The edge is judged at the true displacement (point_id, u, v, w) where it is known, else at either code's.
    """
    m = metrics.match(ours, theirs)
    at = lambda p: (tuple(C(f"{p}_{a}") for a in "xyz"), tuple(C(f"{p}_{c}") for c in "uvw"))
    if truth is not None:
        m = m.join(truth.select("point_id", *[C(c).alias(f"t_{c}") for c in "uvw"]), "point_id")
        edge = edge_mask(at("a")[0], tuple(C(f"t_{c}") for c in "uvw"), shape, reach)
    else:
        edge = edge_mask(*at("a"), shape, reach) | edge_mask(*at("b"), shape, reach)
    m = m.withColumn("interior", ~edge)
    good = [((C(f"{p}_status") == 0) & C("interior")).alias(f"{p}_good") for p in "ab"]
    return m.select("point_id", "interior", *good, *[C(f"{p}_{c}") for p in "ab" for c in ("status", "u", "v", "w")])


def self_agreement(one: DataFrame, again: DataFrame) -> DataFrame:
    """One row: points of two runs of one code, how many have the same status, and how far those differ at most."""
    m = metrics.match(one, again)
    same = C("a_status") == C("b_status")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("status_same"), F.max(F.when(same, F.greatest(*[F.abs(C(f"a_{c}") - C(f"b_{c}")) for c in "uvw"]))).alias("max_abs"))


def complete_cells(arrays: list[DataFrame]) -> DataFrame:
    """Cells (cx, cy, cz) that every array of a store holds; a cell that only some hold was interrupted."""
    return reduce(lambda a, b: a.intersect(b), [a.select("cx", "cy", "cz") for a in arrays])


def junit_counts(suites: DataFrame) -> DataFrame:
    """One row of totals from a row for each test suite."""
    return suites.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tests", "failures", "errors", "skipped")])


def verdict(status: str | Column = "status", name: str | Column = "name", required: bool = False, prefix: str = "case A") -> Column:
    """An aggregate over the rows of a report: FAIL if any failed (or the ``prefix`` step was skipped although required),
    WARN if any warned, PASS (partial) if the step was skipped, else PASS."""
    s, n = (C(x) if isinstance(x, str) else x for x in (status, name))
    skipped = F.coalesce(F.bool_or((s == "skip") & n.startswith(prefix)), F.lit(False))
    some = lambda what: F.coalesce(F.bool_or(s == what), F.lit(False))
    return F.when(some("fail") | (skipped & F.lit(required)), "FAIL").when(some("warn"), "WARN").when(skipped, "PASS (partial)").otherwise("PASS")


def cells_per_tile(tile: tuple[float, float, float], cell: tuple[float, float, float]) -> tuple[int, int, int]:
    """How many cells a tile has along each axis; it must be a whole number within one hundredth."""
    out = []
    for t, c in zip(tile, cell, strict=True):
        n = round(t / c)
        if n < 1 or abs(t / c - n) > 0.01 * (t / c):
            raise ValueError(f"tile {tile} is not a whole number of cells {cell}")
        out.append(n)
    return tuple(out)
