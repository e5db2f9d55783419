"""Accuracy and agreement of result tables (point_id, x, y, z, status, objmin, u, v, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrvox.operators.quantiles import quantiles
from corrvox.operators.tables import cut

C = F.col
GOOD = 0
AXES = "uvw"


def to_ccpi(status):
    return F.greatest(status, F.lit(-3))


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both results at the ids they share: columns of ``a`` prefixed a_, of ``b`` b_."""
    p = a.select("point_id", *[C(c).alias(f"a_{c}") for c in a.columns if c != "point_id"])
    q = b.select("point_id", *[C(c).alias(f"b_{c}") for c in b.columns if c != "point_id"])
    return p.join(q, "point_id")


def with_error(m: DataFrame) -> DataFrame:
    d = [C(f"a_{c}") - C(f"b_{c}") for c in AXES]
    m = m.select("*", *[e.alias(f"e{c}") for e, c in zip(d, AXES, strict=True)])
    return m.withColumn("mag", F.sqrt(C("eu") * C("eu") + C("ev") * C("ev") + C("ew") * C("ew")))


def accuracy_columns(good, digits: int = 9) -> list:
    """Aggregates of the error over the rows where ``good``: bias and rmse by axis."""
    e = {c: F.when(good, C(f"e{c}")) for c in AXES}
    out = [F.round(F.avg(e[c]), digits).alias(f"bias_{c}") for c in AXES]
    return out + [F.round(F.sqrt(F.avg(e[c] * e[c])), digits).alias(f"rmse_{c}") for c in AXES]


SHARES = {f"p{q}": q / 100 for q in (50, 95, 99)}


def _sizes(m: DataFrame, groups: list[str], digits: int = 9) -> DataFrame:
    """Exact quantiles of the error's size."""
    found = quantiles(m, groups, "mag", SHARES, cut, written=True)
    return found.select(*groups, *[F.round(p, digits).alias(p) for p in SHARES])


def accuracy(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: errors of the GOOD points of ``result`` against ``truth`` (point_id, u, v, w)."""
    good = C("a_status") == GOOD
    m = cut(with_error(match(result, truth)).select("a_status", *[f"e{c}" for c in AXES], "mag"))
    one = m.agg(F.count(F.lit(1)).alias("n_points"), F.count(F.when(good, 1)).alias("n_good"), F.round(F.avg(good.cast("double")), 9).alias("frac_good"), *accuracy_columns(good))
    return one.join(F.broadcast(_sizes(m.where(good), [])), how="left")  # a row each


def missing(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth points without a result."""
    return truth.join(result, "point_id", "left_anti")


def agreement(ours: DataFrame, theirs: DataFrame, edge) -> DataFrame:
    """Agreement over all points and by edge, in one pass, and quantiles of both; ``edge``: an expression over b_ columns."""
    m = cut(with_error(match(ours, theirs)).select("a_status", "b_status", *[f"e{c}" for c in AXES], "mag", edge.alias("edge")))
    both = (C("a_status") == GOOD) & (C("b_status") == GOOD)
    same = (to_ccpi(C("a_status")) == C("b_status")).cast("double")
    part = F.when(F.grouping("edge") == 1, "all").when(C("edge"), "edge").otherwise("interior")
    counted = m.groupingSets([[], [C("edge")]], C("edge")).agg(
        part.alias("part"), F.count(F.lit(1)).alias("n_points"), F.count(F.when(both, 1)).alias("n_good_both"),
        F.round(F.avg(same), 9).alias("status_agreement"), *accuracy_columns(both),
    ).drop("edge")
    good = m.where(both).select("mag", F.explode(F.array(F.lit("all"), F.when(C("edge"), "edge").otherwise("interior"))).alias("part"))
    return counted.join(F.broadcast(_sizes(good, ["part"])), "part", "left")  # three rows
