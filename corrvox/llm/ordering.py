"""Places of rows in a total order, found range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize, partitions


def numbered(df: DataFrame, group: list[str], order: list[str], place: str = "pos") -> tuple[DataFrame, DataFrame]:
    """``df`` with the place (from 0) of each row in its group, and a table of group sizes.

    Sampled splitters over (group, order) deal the rows into ranges, so a group of any size is cut over as many tasks as it
    fills. The sorted ranges are written once; counts of (group, range) then give each range's first place. ``order`` must
    be a total order, else rows that tie get places in any order. Nulls come first, strings compare by their bytes.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(partitions(spark), *group, *order).sortWithinPartitions(*group, *order)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(cut.withColumns({"_part": F.spark_partition_id(), "_index": index}), "ranges")
    spans = materialize(rows.groupBy("_part", *group).agg(F.min("_index").alias("_low"), F.count(F.lit(1)).alias("_n")), "spans")
    sizes = spans.groupBy(*group).agg(F.sum("_n").alias("size"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    keys = {g: f"_of_{g}" for g in group}
    spans = spans.select(F.col("_part").alias("_of_part"), *[F.col(g).alias(k) for g, k in keys.items()], (before - F.col("_low")).alias("_shift"))
    on = F.col("_part") == F.col("_of_part")
    for g, k in keys.items():
        on = on & F.col(g).eqNullSafe(F.col(k))
    return join_small(rows, spans, on).withColumn(place, F.col("_index") + F.col("_shift")).select(*df.columns, place), sizes
