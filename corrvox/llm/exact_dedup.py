r"""Exact dedup by content sort.

Texts are equal when they are identical after every run of ``[\x20\x09-\x0D]`` is one space.
Sampled splitters (``repartitionByRange``) range-partition the normalised bytes: by the first ``HEAD``
of them, then a digest of all, then the row's identifier, so that a splitter is short however long
texts are. Spark's external sort places equal texts next to each other, and each row is compared
in full with its neighbour. The identifier is part of the key, so a group that holds
a third of all rows is cut over as many partitions as it fills; runs that cross a partition edge
are joined afterwards from one summary row per edge.

Null text counts as empty. Of equal texts the smallest identifier stays; of rows that repeat the
identifier too, one stays. Rows with a null identifier sort last in their group. An empty table
gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrvox.llm.common import materialize, partitions

HEAD = 64
SPACES = r"[\x20\x09-\x0D]+"

_RUNS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_sha256", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("run", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("edge_text", T.StringType()),
    T.StructField("edge", T.StringType()),
])


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of one sorted partition; keep texts of its first and last row only."""
    from pyspark import TaskContext

    part, run, pos = TaskContext.get().partitionId(), -1, -1
    last, held = None, None  # the last text; the last output batch, kept until its end is known to be the edge
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("pos", pa.int64()), ("edge_text", pa.string()), ("edge", pa.string())])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column("norm")
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = last is None
        new[0] = first or text[0].as_py() != last
        runs = run + np.cumsum(new)
        starts = np.where(new, np.arange(n), -1)
        at = np.maximum.accumulate(starts)
        place = np.where(at >= 0, np.arange(n) - at, pos + 1 + np.arange(n))
        run, pos, last = int(runs[-1]), int(place[-1]), text[n - 1].as_py()
        if held is not None:
            yield held
        texts, edge = [None] * n, [None] * n
        if first:
            texts[0], edge[0] = last if n == 1 else text[0].as_py(), "first"
        held = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(texts, pa.string()), pa.array(edge, pa.string())], schema=schema)
    if held is not None:
        n = held.num_rows
        texts, edge = held.column("edge_text").to_pylist(), held.column("edge").to_pylist()
        texts[-1], edge[-1] = last, "both" if edge[-1] else "last"
        yield pa.RecordBatch.from_arrays([*held.columns[:5], pa.array(texts, pa.string()), pa.array(edge, pa.string())], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    parts = parts or 2 * partitions(spark)
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    ordered = (
        norm.withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))
        .withColumn("head", F.substring("norm", 1, HEAD))
        .repartitionByRange(parts, "head", "text_sha256", F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions("head", "text_sha256", "norm", F.col("doc_id").asc_nulls_last())
        .drop("head")
    )
    rows = materialize(ordered.mapInArrow(_number_runs, _RUNS), "runs")

    # Edges: a partition's last run goes on in the next partition that has rows. Two rows at most for
    # each partition meet here, whatever the input; texts are compared where they are, in full.
    edges = rows.where("edge is not null").select("part", "run", "doc_id", "edge_text", "edge")
    order = {p: i for i, p in enumerate(sorted(r[0] for r in edges.select("part").distinct().collect()))}
    joined: dict[int, bool] = {}
    if len(order) > 1:
        nxt = spark.createDataFrame([(p, q) for p, q in zip(list(order)[:-1], list(order)[1:], strict=True)], "part int, next int")
        a = edges.where("edge != 'first'").select("part", F.col("edge_text").alias("a_text"))
        b = edges.where("edge != 'last'").select(F.col("part").alias("next"), F.col("edge_text").alias("b_text"))
        same = a.join(F.broadcast(nxt), "part").join(b, "next").select("part", (F.col("a_text") == F.col("b_text")).alias("same"))
        joined = {r["part"]: r["same"] for r in same.collect()}
    runs = rows.groupBy("part", "run").agg(
        F.min_by("doc_id", "pos").alias("first_id"), F.count(F.lit(1)).alias("size")
    )
    # Of each partition only the first and last run can cross an edge.
    bounds = edges.select("part", "run").distinct().join(runs, ["part", "run"]).collect() if any(joined.values()) else []
    of = {(r["part"], r["run"]): (r["first_id"], r["size"]) for r in bounds}
    spans: list[tuple[int, int, int | None, int, bool]] = []
    chain: list[tuple[int, int]] = []

    def close() -> None:
        if len(chain) > 1:
            first, size = of[chain[0]][0], sum(of[k][1] for k in chain)
            spans.extend((p, r, first, size, k == 0) for k, (p, r) in enumerate(chain))

    ends: dict[int, tuple[int, int]] = {}
    for p, r in of:
        lo, hi = ends.get(p, (r, r))
        ends[p] = min(lo, r), max(hi, r)
    for p in order if of else ():
        lo, hi = ends[p]
        if not (chain and joined.get(chain[-1][0])):
            close()
            chain = []
        chain.append((p, lo))
        if hi != lo:
            close()
            chain = [(p, hi)]
    close()

    groups = runs.where("size > 1").withColumn("lead", F.lit(True))
    if spans:  # two rows for each partition at most
        fix = spark.createDataFrame(spans, "part int, run long, whole_first long, whole_size long, whole_lead boolean")
        groups = runs.join(F.broadcast(fix), ["part", "run"], "left").where("size > 1 or whole_size > 1").select(
            "part", "run",
            F.when(F.col("whole_size").isNull(), F.col("first_id")).otherwise(F.col("whole_first")).alias("first_id"),
            F.coalesce("whole_size", "size").alias("size"),
            F.coalesce("whole_lead", F.lit(True)).alias("lead"),
        )
    out = rows.select("doc_id", "text_sha256", "part", "run", "pos").join(groups, ["part", "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("pos") == 0) & F.coalesce("lead", F.lit(True))).alias("kept"),
        "text_sha256",
    )
