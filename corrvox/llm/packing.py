"""Best-fit packing by hierarchical residual packing.

Documents are tokenised and cut into pieces (only those over the limit). Each partition packs its
pieces best-fit decreasing and closes the bins that are nearly full. Underfull bins go up a tree
as items of their fill: at each level ``fan_in`` nodes merge, pack again best-fit, and close what
is nearly full. At the root, bins of the same fill are alike, so the tree's last merge is of
counts by fill (``capacity`` numbers at most, whatever the input); one best-fit decreasing round
over these counts places all that is left, and ranks within a fill turn the plan into places.

Null text counts as empty: a document has its end id at least, so a length of 1. Repeated rows are
packed each. Null identifiers are kept. Extra columns are not read, whatever their names. Very long
texts are cut into pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import TEXT_ROWS, materialize
from corrvox.llm.tokens import chunks, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", drops_spaces: bool = True) -> DataFrame:
    """Tokenise every row's whole text; a row (PIECES) for each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drops_spaces)
        for b in batches:
            for lo, hi in chunks(b.column("text")):
                part = b.slice(lo, hi - lo)
                flat, starts = enc.column(part.column("text"))
                pa.default_memory_pool().release_unused()  # what the words took; else the worker keeps it
                many = -(-np.diff(starts) // capacity)
                doc = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                at = starts[doc] + piece * capacity
                end = np.minimum(at + capacity, starts[doc + 1])
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(at.tolist(), end.tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(end - at), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Bin and place of each item; fill of each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, places, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit f is set if a bin has f places left
    for i in order.tolist():
        n = int(sizes[i])
        above = free >> n
        if above:
            f = n + (above & -above).bit_length() - 1
            k = room[f].pop()
            if not room[f]:
                free &= ~(1 << f)
        else:
            k, f = len(fills), capacity
            fills.append(0)
        bins[i], places[i] = k, fills[k]
        fills[k] += n
        if f > n:
            room[f - n].append(k)
            free |= 1 << (f - n)
    return bins, places, np.array(fills, np.int64)


def plan_counts(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts of sizes: (sizes in a bin, number of such bins)."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    free = 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            above = free >> size
            if above:
                f = size + (above & -above).bit_length() - 1
                inside, many = room[f].pop()
                take = min(left, many)
                if take < many:
                    room[f].append((inside, many - take))
                new = [([*inside, size], take, f - size)]
                left -= take
                if not room[f]:
                    free &= ~(1 << f)
            else:
                each = capacity // size
                whole, rest = divmod(left, each)
                new = [([size] * each, whole, capacity - each * size), ([size] * rest, int(rest > 0), capacity - rest * size)]
                left = 0
            for inside, many, f in new:
                if many:
                    room.setdefault(f, []).append((inside, many))
                    free |= 1 << f
    return [x for held in room.values() for x in held if x[1]]


_NODE = "bin long, node long, place long, fill long"


def _pack_node(level: int, capacity: int, batch_items: int):
    """Best-fit over the rows (bin, size) of a partition, ``batch_items`` at a time; node ids are unique by level and partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (level << 58) | (TaskContext.get().partitionId() << 34)
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t.column("size").to_numpy()
            bins, places, fills = best_fit(sizes, capacity)
            cols = [pa.array(first + bins), pa.array(places), pa.array(fills[bins])]
            first += len(fills)
            for name, col in zip(("node", "place", "fill"), cols, strict=True):
                t = t.append_column(name, col)
            yield from t.drop_columns("size").to_batches(max_chunksize=20_000)
            held.clear()

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= batch_items:
                yield from out()
        if held:
            yield from out()

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 2048, nearly: int = 8, fan_in: int = 4, batch_items: int = 200_000) -> DataFrame:
    """``pieces`` (any columns, a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    A bin with fewer than ``nearly`` places left is closed where it is packed, so at most ``nearly - 1`` places of it are lost.
    """
    if pieces.where((F.col("length") > capacity) | (F.col("length") < 1)).limit(1).count():
        raise ValueError("a piece is longer than a sequence, or empty")
    own = pieces.columns
    start = pieces.withColumn("size", F.col("length"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", node long, place long, fill long"
    local = materialize(start.mapInArrow(_pack_node(0, capacity, batch_items), schema), "bins")
    open_ = F.col("fill") <= capacity - nearly
    # A row for each underfull bin: its id, the node that holds it now, its place there, and the node's fill.
    held = local.where(open_ & (F.col("place") == 0)).select(F.col("node").alias("bin"), "node", F.lit(0).cast("long").alias("place"), "fill")
    level, nodes = 1, max(1, local.rdd.getNumPartitions())
    done: DataFrame | None = None
    while nodes > fan_in:
        nodes = -(-nodes // fan_in)
        items = held.where("place = 0").select(F.col("node").alias("bin"), F.col("fill").alias("size"))
        items = items.distinct().repartition(nodes)
        up = materialize(items.mapInArrow(_pack_node(level, capacity, batch_items), _NODE), "level")
        moved = held.select("bin", F.col("node").alias("was"), F.col("place").alias("was_at")).join(up.withColumnRenamed("bin", "was"), "was")
        moved = materialize(moved.select("bin", "node", (F.col("was_at") + F.col("place")).alias("place"), "fill"), "moved")
        closed = moved.where(~open_).select("bin", "node", "place")
        done = closed if done is None else done.unionByName(closed)
        held = moved.where(open_)
        level += 1

    tops = held.where("place = 0").select("node", "fill").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(64)))
    by = {(r["fill"], r["bucket"]): r["count"] for r in tops.groupBy("fill", "bucket").count().collect()}  # capacity x 64 rows at most
    counts: dict[int, int] = {}
    firsts = []
    for fill, bucket in sorted(by):
        firsts.append((fill, bucket, counts.get(fill, 0)))
        counts[fill] = counts.get(fill, 0) + by[fill, bucket]
    slots, at, seq = [], dict.fromkeys(counts, 0), level << 58
    for inside, many in plan_counts(counts, capacity):
        place = 0
        for size in inside:
            slots.append((size, at[size], seq - at[size], place))
            at[size] += many
            place += size
        seq += many
    # Slots by (fill, first rank): a bin of that fill and rank finds its slot by binary search. Their number follows from the
    # fills that occur (capacity at most), not from the number of bins.
    fills, los, shifts, ats = np.array(sorted(slots), np.int64).reshape(-1, 4).T

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fill, rank = b.column("fill").to_numpy(), b.column("rank").to_numpy()
            begin = np.searchsorted(fills, fill)
            slot = np.empty(len(fill), np.int64)
            for f in np.unique(fill):
                own = fill == f
                a, z = np.searchsorted(fills, [f, f + 1])
                slot[own] = begin[own] + np.searchsorted(los[a:z], rank[own], "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(rank + shifts[slot]), pa.array(ats[slot])], names=["node", "top", "at"])

    spark = pieces.sparkSession
    first = spark.createDataFrame(firsts, "fill long, bucket long, first long")
    ranked = tops.withColumn("n", F.row_number().over(Window.partitionBy("fill", "bucket").orderBy("node")) - 1).join(F.broadcast(first), ["fill", "bucket"]).select("node", "fill", (F.col("first") + F.col("n")).alias("rank"))
    root = ranked.mapInArrow(place_, "node long, top long, at long")
    last = held.join(root, "node").select("bin", F.col("top").alias("node"), (F.col("place") + F.col("at")).alias("place"))
    moves = last if done is None else last.unionByName(done)
    moves = moves.select(F.col("bin").alias("node"), F.col("node").alias("sequence_id"), F.col("place").alias("shift"))
    out = local.where(open_).join(moves, "node").select(*own, "sequence_id", (F.col("place") + F.col("shift")).alias("offset"))
    return local.where(~open_).select(*own, F.col("node").alias("sequence_id"), F.col("place").alias("offset")).unionByName(out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **kw) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    return pack_pieces(materialize(pieces_of(docs, tokenizer, capacity, **kw), "pieces", TEXT_ROWS), capacity)
