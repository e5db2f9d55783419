r"""Near duplicates by SimHash fingerprints and anchor-point covering.

A-Z are lower-cased; words are ``[^\x20\x09-\x0D]+``; a document's shingles are its runs of four words joined by a space,
repeats included (with fewer words the whole sequence, without words none: fingerprint zero). A bit of the fingerprint is 1
where it is set in more than half of the shingles' XXH64 (seed 42). Fingerprints of at most four differing bits are linked.

**Covering.** Of two fingerprints that differ in four bits at most, one of the halves differs in two at most. The anchors of a
half are the product of the perfect Hamming code of length 31 and the one free bit: 2**27 points, no point further than R = 1
from its nearest one. Two halves that differ in two bits have a point between them, one bit from each, and that point's anchor
lies within R + 1 of both: so the threshold of 2 is shared, and a fingerprint goes to every anchor within R + 1 of each of its
halves (2 or 17 of them, found from the syndrome, at most 34 in all), instead of within R + 2 of one side (over 300). No link
is lost. Under one anchor fingerprints are compared in full.

Copies are one fingerprint with a count before anything is compared. An anchor of more than ``BLOCK`` fingerprints is
compared in pairs of blocks, so a task holds two blocks however full an anchor is. Of a block pair's links
each member's connection with the first of its connected part is returned, so a dense group gives fewer rows than members, and
pairs that are connected already are not compared.

Null text counts as empty. Null identifiers have fingerprints and link others, but are never a component's smallest unless
there is no other. Repeated rows stay rows. Very long texts are read whole, one row at a time. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize, partitions, release
from corrvox.llm.graph import connected_components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
BLOCK = 2048
#: Fingerprints that are held in a task at a time, and pairs that are compared at a time.
CHUNK, PAIRS = 1 << 16, 1 << 21

_SPACES = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256)).lower()
#: The eight bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_SPACES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    parts = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def fingerprint_of(text: bytes) -> int:
    h = shingle_hashes(text)
    if not len(h):
        return 0
    by_byte = h.view(np.uint8).reshape(-1, 8)
    if len(h) > 1000:  # counts of byte values, then their bits
        ones = np.stack([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    else:
        ones = _BITS[by_byte].sum(axis=0)
    over = (2 * ones > len(h)).reshape(64)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp): every fingerprint with each anchor within R + 1 of one of its halves.

    An anchor's key is the half's number, the free bit and the code word. Positions in a word are 1 to 31; its syndrome is the
    exclusive or of the positions that are set. Code words within two flips of it are reached by flipping {p, p ^ syndrome},
    where position 0 flips nothing; with the free bit changed too only the nearest one is.
    """
    flip = "IF({0} = 0, 0L, shiftleft(1L, {0} - 1))"
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    syndrome = " + ".join(f"shiftleft(bit_count(word & {m}L) & 1, {j})" for j, m in enumerate(masks))
    two = f"transform(filter(sequence(0, 31), p -> p < (p ^ s)), p -> base ^ word ^ {flip.format('p')} ^ {flip.format('(p ^ s)')})"
    found = None
    for half in (0, 1):
        at = fps.selectExpr("fp", f"shiftrightunsigned(fp, {32 * half}) & {0xFFFFFFFF}L AS bits")
        at = at.selectExpr("fp", f"bits & {0x7FFFFFFF}L AS word", f"(bits & {1 << 31}L) + {half << 32}L AS base")
        at = at.selectExpr("*", f"{syndrome} AS s").selectExpr("*", f"base ^ word ^ {flip.format('s')} AS nearest")
        keys = F.expr(f"concat(IF(s = 0, array(nearest), {two}), array(nearest ^ {1 << 31}L))")
        rows = at.select(F.explode(keys).alias("anchor"), "fp")
        found = rows if found is None else found.unionByName(rows)
    return found


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each component) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        if (same := x == y).all():
            return label
        x, y = x[~same], y[~same]
        a, b = a[~same], b[~same]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up


def _linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by group), and the first row that each reaches by links inside its group; first rows are left out.

    ``side``: 0 and 1 are two blocks of which only pairs across are compared, 2 is one block within itself.
    """
    n = len(fp)
    last = np.searchsorted(group, group, side="right")  # one past the end of each row's group
    rest = last - np.arange(n) - 1
    label = np.arange(n)
    done = 0
    while done < n:
        upto = done + max(1, int(np.searchsorted(np.cumsum(rest[done:]), PAIRS, side="right")))
        a = np.repeat(np.arange(done, upto), rest[done:upto])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest[done:upto]) - rest[done:upto], rest[done:upto])
        keep = (label[a] != label[b]) & ((side[a] == 2) | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD
        label = _forest(a[near], b[near], label)
        done = upto
    below = np.flatnonzero(label != np.arange(n))
    return below, label[below]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (anchor, p, q, side, fp): whole groups are gathered up to CHUNK rows or one group."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        group = np.concatenate([[0], np.cumsum(new)])
        a, b = _linked(group, rows[:, 3], np.ascontiguousarray(rows[:, 4]).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 4]), pa.array(rows[b, 4])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1))
        if sum(map(len, held)) >= CHUNK:
            rows = np.concatenate(held)
            own = np.all(rows[:, :3] == rows[-1, :3], axis=1)
            cut = len(rows) - int(own.sum())
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
    if held:
        yield links(np.concatenate(held))


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs that connect all of the distinct fingerprints ``fp`` which links reach (a pair itself may be further apart)."""
    copies = replicas(fps)
    sizes = materialize(copies.groupBy("anchor").count().where("count > 1"), "anchors")
    rows = join_small(copies, sizes, "anchor")
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = rows.select("anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "fp")
    dealt = dealt.repartition(partitions(fps.sparkSession), "anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
    out = materialize(dealt.mapInArrow(_compare, "a long, b long").distinct(), "links")
    release(sizes)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    links = fingerprint_links(each.select("fp"), block)
    found = connected_components(links)
    low = each.join(found, each["fp"] == found["node"]).groupBy("component").agg(F.min("first").alias("low"))
    names = join_small(found, low, "component").select(F.col("node").alias("fp"), "low")
    named = materialize(each.join(names, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id")), "named")
    # A fingerprint of more than a 4 * partitions-th of all rows is hot: there are at most 4 * partitions of these.
    count, slices = rows.count(), 4 * partitions(docs.sparkSession)
    hot = F.col("n") > count / slices
    other = named.where(~hot).select("fp", "component_id")
    hot = named.where(hot).select("fp", "component_id")
    out = rows.join(F.broadcast(hot), "fp").unionByName(rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(other, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
