"""Exact quantiles of groups of any size, by selection over counting passes.

A quantile is a value at a rank. Each pass counts the values between a rank's bounds by ``WIDTH`` steps of equal length, keeps
the step that holds the rank, and takes the least and greatest value in it as new bounds: so the bounds are values, ties
end at once, outliers cost one pass, and a pass always divides what is left. When at most ``FEW`` values are left, they are
sorted; where no group has more from the start, that is all there is to do. A task's state is a row for each step, or ``FEW`` values, whatever the group holds; counts are summed before the
shuffle. Ranks that share bounds share a pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
FEW, WIDTH, BROADCAST = 1 << 18, 1024, 100_000
BOUNDS = ["key", "lo", "hi"]


def quantiles(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float], cut: Callable[[DataFrame], DataFrame], few: int = FEW, width: int = WIDTH, written: bool = False) -> DataFrame:
    """The groups' columns and a column for each of ``fractions``, interpolated between neighbouring values.

    Null and not finite values are left out; a group without others has no row. ``cut`` writes rows and reads them back;
    ``written``: ``df`` is read from such rows already.
    """
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    v = C(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*groups, key.alias("key"), v.alias("v"))
    rows = rows if written else cut(rows)
    sizes = cut(rows.groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    of = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if of["most"] <= few:
        shares = [F.percentile("v", F.lit(float(p))).alias(name) for name, p in fractions.items()]
        return rows.groupBy(*groups).agg(*shares) if groups else rows.groupBy("key").agg(*shares).drop("key")
    small = of["groups"] * len(fractions) <= BROADCAST
    near = lambda bounds: F.broadcast(bounds) if small else bounds  # noqa: E731  a row or two for each group and fraction

    places = [F.lit(float(p)) * (C("n") - 1) for p in fractions.values()]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    targets = sizes.select("key", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), C("n").alias("inside"))
    found = []
    wide = (C("inside") > few) & (C("lo") < C("hi"))
    while True:
        found.append(targets.where(~wide))
        open_ = targets.where(wide)
        if not open_.limit(1).count():
            break
        step = F.least(F.floor((C("v") / 2 - C("lo") / 2) / (C("hi") / 2 - C("lo") / 2) * width), F.lit(width - 1)).cast("int")
        held = rows.select("key", "v").join(near(open_.select(*BOUNDS).distinct()), "key").where(C("v").between(C("lo"), C("hi")))
        steps = held.groupBy(*BOUNDS, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        steps = steps.withColumn("upto", F.sum("n").over(Window.partitionBy(*BOUNDS).orderBy("step")))
        mine = open_.join(steps, BOUNDS).where((C("before") + C("upto") > C("rank")) & (C("before") + C("upto") - C("n") <= C("rank")))
        targets = cut(mine.select("key", "rank", C("least").alias("lo"), C("most").alias("hi"), (C("before") + C("upto") - C("n")).alias("before"), C("n").alias("inside")))
    targets = cut(reduce(DataFrame.unionByName, found))
    last = rows.select("key", "v").join(near(targets.where("lo < hi").select(*BOUNDS).distinct()), "key").where(C("v").between(C("lo"), C("hi")))
    sorted_ = last.groupBy(*BOUNDS).agg(F.array_sort(F.collect_list("v")).alias("values"))
    at = targets.join(sorted_, BOUNDS, "left").select("key", "rank", F.coalesce(F.get("values", (C("rank") - C("before")).cast("int")), C("lo")).alias("v"))
    by_rank = at.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    cols = []
    for name, p in zip(fractions, places, strict=True):
        a, b = (F.element_at("at", f(p).cast("long")) for f in (F.floor, F.ceil))
        cols.append((a + (b - a) * (p - F.floor(p))).alias(name))
    return sizes.join(by_rank, "key").select(*groups, *cols)
