"""Connected components of a relation of links, by rounds of stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node with a link (a, b); component is the smallest node that is reached.

    In a round every node's larger neighbours are tied to its smallest neighbour, then its smaller ones. Neighbourhoods are
    never gathered: only their smallest node is, before the shuffle where it can be. Rounds end when links no longer change.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(C("v").alias("u"), C("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), C("u")).alias("m"))
        e = cut(both.where("v > u").join(low, "u").select(C("v").alias("u"), C("m").alias("v")).where("u > v").distinct())
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(low, "u")
        e = cut(tied.select("u", C("m").alias("v")).unionByName(tied.where("v > m").select(C("v").alias("u"), C("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(C("u").alias("node"), C("v").alias("component")).unionByName(e.select(C("v").alias("node"), C("v").alias("component")).distinct())
