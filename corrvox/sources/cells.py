"""Tables of points (or results) stored by cells: clustered along a Z-order curve, with an index of fragments.

``append`` writes rows in the order of their cell's code, cut into files by ranges of (code, point_id), so a cell of any size
spreads over as many files as it fills; rows of a file keep the order, so each row group holds a short range of codes. A
fragment is what one file holds of one cell: the index has a row for each, with its count, its place in the file and its
extents, and is written after the rows, so rows of a job that did not end are not seen. Counts and extents of cells come
from the index alone.

``read_box`` takes the files from the index, then reads only row groups whose codes can lie in the box: the box as at most
``RANGES`` ranges of codes is pushed down to the files. ``problems`` holds the files against the index.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrvox.functions.geometry import morton_code

C = F.col
#: Cells are numbered from -HALF to HALF - 1 along each axis.
HALF, BITS, RANGES = 1 << 20, 21, 64
#: Small row groups: a box reads few rows besides its own.
GROUP_BYTES = 8 << 20


def _cells(cell: float) -> list[Column]:
    return [F.floor(C(a) / cell).cast("long") for a in "xyz"]


def with_code(points: DataFrame, cell: float) -> DataFrame:
    shifted = [F.when(c.between(-HALF, HALF - 1), c + HALF).otherwise(F.raise_error(F.lit(f"a point lies beyond {HALF} cells of {cell}")).cast("long")) for c in _cells(cell)]
    return points.withColumn("code", morton_code(*shifted))


def append(points: DataFrame, path: str, cell: float, files: int | None = None) -> None:
    """Add rows with point_id, x, y, z (and any other columns but ``code``) to the table at ``path``."""
    spark, rows = points.sparkSession, f"{path}/rows/{uuid.uuid4().hex}"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_code(points, cell).repartitionByRange(files, "code", "point_id").sortWithinPartitions("code", "point_id")
    ordered.write.option("parquet.block.size", GROUP_BYTES).parquet(rows)
    spark.createDataFrame([(float(cell),)], "cell double").write.mode("overwrite").json(f"{path}/settings")
    fragments(spark.read.parquet(rows), cell).orderBy("code", "file").write.mode("append").parquet(f"{path}/index")


def fragments(rows: DataFrame, cell: float) -> DataFrame:
    """A row for each (cell, file): code, cx, cy, cz, file, points, first (its first row in the file), extents."""
    at = rows.select("code", *"xyz", *[c.alias(f"c{a}") for a, c in zip("xyz", _cells(cell), strict=True)], C("_metadata.file_path").alias("file"), C("_metadata.row_index").alias("at"))
    ends = [f(a).alias(f"{a}_{e}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]
    return at.groupBy("code", "cx", "cy", "cz", "file").agg(F.count(F.lit(1)).alias("points"), F.min("at").alias("first"), *ends)


def _cell_size(spark: SparkSession, path: str) -> float:
    return spark.read.json(f"{path}/settings").first()["cell"]


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def cell_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts and extents of the cells that hold points, from the index."""
    ends = [f(f"{a}_{e}").alias(f"{a}_{e}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]
    return index(spark, path).groupBy("cx", "cy", "cz").agg(F.sum("points").alias("points"), *ends)


def code_ranges(lo: tuple[int, int, int], hi: tuple[int, int, int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges [a, b] of codes that hold every cell from lo to hi (both included, not negative), ``most`` or fewer.

    Blocks of the curve that the box cuts are halved until there are too many; blocks that then follow each other are one.
    """
    whole, cut = [], [((0, 0, 0), BITS)]
    while cut:
        nxt = []
        for corner, bits in cut:
            size = 1 << bits
            if any(c > h or c + size <= p for c, p, h in zip(corner, lo, hi, strict=True)):
                continue
            if all(p <= c and c + size - 1 <= h for c, p, h in zip(corner, lo, hi, strict=True)):
                whole.append((corner, bits))
            else:
                half = size >> 1
                nxt += [(tuple(c + half * (k >> j & 1) for j, c in enumerate(corner)), bits - 1) for k in range(8)]
        if len(whole) + len(nxt) > 8 * most:
            whole += cut
            break
        cut = nxt
    code = lambda corner: sum((c >> b & 1) << (3 * b + j) for j, c in enumerate(corner) for b in range(BITS))
    out: list[tuple[int, int]] = []
    for a, b in sorted((code(corner), code(corner) + (1 << 3 * bits) - 1) for corner, bits in set(whole)):
        out = [*out[:-1], (out[-1][0], max(b, out[-1][1]))] if out and a <= out[-1][1] + 1 else [*out, (a, b)]
    while len(out) > most:  # close the narrowest gap
        k = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[k - 1 : k + 1] = [(out[k - 1][0], out[k][1])]
    return out


def read_box(spark: SparkSession, path: str, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Rows of lo <= (x, y, z) < hi. The names of the files that the box touches pass through the driver."""
    cell = _cell_size(spark, path)
    first, last = [math.floor(p / cell) for p in lo], [math.ceil(q / cell) - 1 for q in hi]
    inside = reduce(Column.__and__, [C(f"c{a}").between(p, q) for a, p, q in zip("xyz", first, last, strict=True)])
    touched = index(spark, path).where(inside)
    names = [r["file"] for r in touched.select("file").distinct().collect()]
    if not names:
        return spark.read.parquet(f"{path}/rows/*").drop("code").where(F.lit(False))
    bound = lambda v: min(max(v + HALF, 0), 2 * HALF - 1)
    ranges = code_ranges(tuple(map(bound, first)), tuple(map(bound, last)))
    near = reduce(Column.__or__, [C("code").between(a, b) for a, b in ranges])
    exact = reduce(Column.__and__, [(C(a) >= p) & (C(a) < q) for a, p, q in zip("xyz", lo, hi, strict=True)])
    return spark.read.parquet(*names).where(near).where(exact).drop("code")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the index knows."""
    rows = spark.read.parquet(f"{path}/rows/*")
    known = index(spark, path).select("file").distinct()
    return rows.withColumn("_file", C("_metadata.file_path")).join(known, C("_file") == C("file"), "left_semi").drop("_file", "code")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem, rows) where files and index differ, or rows of a file are out of order. Nothing is returned for a sound table."""
    cell = _cell_size(spark, path)
    rows = spark.read.parquet(f"{path}/rows/*")
    found = fragments(rows, cell).select("code", "file", C("points").alias("has"), C("first").alias("at"))
    both = index(spark, path).join(found, ["code", "file"], "full_outer")
    what = F.when(C("has").isNull(), "fragment is missing").when(C("points").isNull(), "fragment is not in the index").when(C("has") != C("points"), "count differs").when(C("at") != C("first"), "place differs")
    counts = both.select("file", what.alias("problem"), F.coalesce("has", "points").alias("n")).where("problem is not null")
    order = Window.partitionBy("file").orderBy("at")
    back = rows.select(C("_metadata.file_path").alias("file"), C("_metadata.row_index").alias("at"), "code").withColumn("was", F.lag("code").over(order)).where("was > code")
    wrong = with_code(rows.withColumns({"was": C("code"), "file": C("_metadata.file_path")}), cell).where("was != code")
    told = back.select("file", F.lit("rows are out of order").alias("problem"), F.lit(1).cast("long").alias("n")).unionByName(wrong.select("file", F.lit("row is in another cell").alias("problem"), F.lit(1).cast("long").alias("n")))
    return counts.unionByName(told).groupBy("file", "problem").agg(F.sum("n").alias("rows"))
