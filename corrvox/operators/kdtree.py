"""Tiles of bounded cost: a k-d tree over a cloud, split at weighted medians, all nodes of a level at once.

The cloud is counted by fine cells first, so the tree works on counts. A node is split while it holds more than ``most``
points or is longer than ``side``: across its longest axis (ties: x, y, z) at the first place that has half of its points on
the left, or the last place that leaves some on the right. A node of one cell can't be split by place: its points are
dealt over parts by their identifier, since points are solved independently of each other.

Each level is one pass over the cells of the nodes that are still open: a sum by (node, place on the axis) and a window over a
node's places, of which there are as many as cells along the axis. Nothing is collected; a level is written and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
AXES = ("cx", "cy", "cz")


def cell_of(points: DataFrame, cell: float) -> DataFrame:
    return points.select("*", *[F.floor(C(a) / cell).cast("int").alias(f"c{a}") for a in "xyz"])


def _open(cells: DataFrame, most: int, width: int) -> DataFrame:
    """``cells`` of nodes to split, with the node's size and axis, and the cells of the nodes that are leaves (``axis`` null)."""
    sizes = cells.groupBy("node").agg(F.sum("n").alias("size"), *[f(a).alias(f"{e}_{a}") for a in AXES for e, f in (("lo", F.min), ("hi", F.max))])
    spans = [C(f"hi_{a}") - C(f"lo_{a}") for a in AXES]
    longest = F.greatest(*spans)
    split = (longest > 0) & ((C("size") > most) | (longest + 1 > width))
    axis = F.when(split, F.when(spans[0] == longest, 0).when(spans[1] == longest, 1).otherwise(2))
    return cells.join(sizes.select(C("node"), "size", axis.alias("axis")), "node")


def kd_cells(points: DataFrame, most: int, cell: float, side: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cx, cy, cz, n, leaf): every cell that holds points with its leaf. Leaves are named by their path: 1, then 2 k and 2 k + 1."""
    if most < 1 or side < cell:
        raise ValueError("a leaf holds a point at least and is a cell long at least")
    cells = cut(cell_of(points, cell).groupBy(*AXES).agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.lit(1).cast("long")))
    leaves: DataFrame | None = None
    place = F.when(C("axis") == 0, C("cx")).when(C("axis") == 1, C("cy")).otherwise(C("cz"))
    while True:
        dealt = cut(_open(cells, most, int(side // cell)).withColumn("place", place))
        shut = dealt.where("axis IS NULL").select(*AXES, "n", C("node").alias("leaf"))
        leaves = shut if leaves is None else leaves.unionByName(shut)
        again = dealt.where("axis IS NOT NULL")
        if not again.limit(1).count():
            return leaves
        upto = F.sum("n").over(Window.partitionBy("node").orderBy("place"))
        last = F.max("place").over(Window.partitionBy("node"))
        marks = again.groupBy("node", "size", "place").agg(F.sum("n").alias("n")).withColumns({"upto": upto, "last": last}).where("place < last")
        at = marks.groupBy("node").agg(F.coalesce(F.min(F.when(2 * C("upto") >= C("size"), C("place"))), F.max("place")).alias("at"))
        cells = again.join(at, "node").select(*AXES, "n", (2 * C("node") + (C("place") > C("at")).cast("long")).alias("node"))


def kd_tiles(points: DataFrame, most: int, cell: float, side: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``points`` with tx (leaf), ty (part of a leaf that is one full cell), tz (0): keys of tiles of ``most`` points about."""
    leaves = kd_cells(points, most, cell, side, cut)
    # A cell of more than ``most`` points is a leaf by itself.
    parts = F.when(C("n") > most, F.ceil(C("n") / most)).otherwise(1).cast("int")
    named = cut(leaves.select(*AXES, C("leaf").alias("tx"), parts.alias("parts")))
    dealt = cell_of(points, cell).join(named, [*AXES])
    return dealt.withColumns({"ty": F.pmod(F.xxhash64("point_id"), C("parts")).cast("int"), "tz": F.lit(0)}).select(*points.columns, "tx", "ty", "tz")
