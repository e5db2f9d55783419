r"""N-gram Jaccard join by prefix trees.

Two documents link when 100 * |A and B| >= 80 * |A or B| over their distinct 5-word shingles.

1. Documents with equal sets are one node (its smallest identifier); copies are never paired.
2. All shingles have one order: rarest first by the number of nodes that hold them (in ``CLASSES``
   classes of its logarithm), then by hash.
   Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each, and shingles that one
   node holds can't be shared, so a node posts only the shared ones among its first.
3. Nodes that post the same shingle are candidates. In rounds, each shingle's nodes are paired with
   one pivot, then four (those with the fewest shingles of their own, from different components),
   until its nodes are one component. Where they still are not, all their pairs across components
   are looked at: of up to ``FEW`` nodes by a join with length and position bounds, of more nodes by
   tries of their posted beginnings, in blocks of ``BLOCK`` x ``BLOCK``; a pair comes from the first
   shingle it shares. This round is never left out, whatever those before it found.
4. Candidates are verified centre by centre: the partners' sets (ordered by hash, ``BLOCK`` of
   them at most) are stored in a path-compressed trie, the centre's set walks it once, partners
   share the counting of common beginnings, and a subtree is left when its remaining lengths can't
   reach the overlap that its shortest set needs. The test at the leaves is exact.

Pairs inside one component are left out once they are known to be connected, so the result has
each document's component, not all links. Null and empty texts have no shingles and link with
nothing. Rows with a null identifier are returned with a null component. Repeated rows get a row
each; rows that repeat an identifier with another text link what both link. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import TEXT_ROWS, join_small, materialize, partitions, release
from corrvox.llm.graph import connected_components
from corrvox.llm.shingles import blocks, shingle_hashes

BLOCK = 256
#: Pivots of a shingle in each round, before all pairs across components are taken.
PIVOTS = (1, 4)
FEW = 32
#: A shingle's key is its bucket and 32 bits of its hash, so up to 2**24 buckets (2 * 10**13 shingles) have distinct numbers.
_KEY_BITS, CLASSES = 56, 256
_MASK = (1 << _KEY_BITS) - 1


def prefix_size(n):
    """How many of a set's first shingles must be looked at (ints, arrays or columns of longs)."""
    return n - (4 * n + 4) // 5 + 1


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for a, b in blocks(texts):
        for h in shingle_hashes(texts[a:b]):
            yield np.unique(h)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, fp = [], []
        for s in _sets(b.column("text").to_pylist()):
            n.append(len(s))
            fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary())], names=["doc_id", "n", "fp"])


def _packed_shingles(buckets: int):
    """The shingles of all sets, packed by bucket of the hash."""

    def flush(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        h, who, place = h[order], who[order], place[order]
        names, starts = np.unique(place, return_index=True)
        own = np.array(ids, np.int64)
        rows = []
        for k, a, z in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
            local, at = np.unique(who[a:z], return_inverse=True)
            rows.append((k, (h[a:z] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), at.astype("<u2").tobytes(), own[local].astype("<i8").tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["bucket", "low", "who", "reps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        size = 0
        for b in batches:
            for doc, s in zip(b.column("doc_id").to_pylist(), _sets(b.column("text").to_pylist()), strict=True):
                if not len(s):
                    continue
                ids.append(doc)
                sets.append(s)
                size += len(s)
                if size >= 1_000_000 or len(ids) >= 60_000:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _shared():
    """Rows (rep, key, df) of the shingles of a bucket that two nodes hold at least; input sorted by bucket."""

    def close(bucket: int, held: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(x[0], "<u4") for x in held])
        rep = np.concatenate([np.frombuffer(x[2], "<i8")[np.frombuffer(x[1], "<u2")] for x in held])
        order = np.lexsort((rep, low))
        low, rep = low[order], rep[order]
        again = np.zeros(len(low), bool)
        again[1:] = (low[1:] == low[:-1]) & (rep[1:] == rep[:-1])
        low, rep = low[~again], rep[~again]
        _, at, df = np.unique(low, return_inverse=True, return_counts=True)
        df = df[at]
        keep = df > 1
        low, rep, df = low[keep], rep[keep], df[keep]
        key = (np.int64(bucket) << np.int64(32)) | low.astype(np.int64)
        for k in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rep[k : k + 100_000]), pa.array(key[k : k + 100_000]), pa.array(df[k : k + 100_000].astype(np.int64))], names=["rep", "key", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "low", "who", "reps")), strict=True):
                if k != now and held:
                    yield from close(now, held)
                    held = []
                now = k
                held.append(tuple(row))
        if held:
            yield from close(now, held)

    return run


class Trie:
    """A path-compressed trie of ascending 64-bit sequences, which are sets or the beginnings of sets.

    ``sizes``: of the whole sets; ``lone``: how many members come before the sequence and match nothing.
    ``linked`` finds the sets whose Jaccard similarity with another can be 0.8 or more: exact for whole
    sets, an upper bound for beginnings.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None, lone: list[int] | None = None) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = [len(s) for s in self.sets] if sizes is None else [sizes[i] for i in self.order]
        self.rest = self.sizes if lone is None else [sizes[i] - lone[i] for i in self.order]
        self.root = self._build(0, len(self.sets), 0) if sets else None

    def _build(self, lo: int, hi: int, depth: int) -> tuple:
        """(edge, depth before it, sets that end here, children, least size and most rest below)."""
        a, z = self.sets[lo], self.sets[hi - 1]
        m = min(len(a), len(z))
        differ = np.flatnonzero(a[depth:m] != z[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        ends = [i for i in range(lo, hi) if len(self.sets[i]) == to]
        children, i = [], lo + len(ends)
        while i < hi:
            j = i + 1
            while j < hi and self.sets[j][to] == self.sets[i][to]:
                j += 1
            children.append(self._build(i, j, to))
            i = j
        return a[depth:to], depth, ends, children, min(self.sizes[lo:hi]), max(self.rest[lo:hi])

    def linked(self, probe: np.ndarray, size: int | None = None, lone: int = 0, first: int = 0) -> list[int]:
        """``first``: leave subtrees that share something before it (their pairs come from there)."""
        size = len(probe) if size is None else size
        found: list[int] = []
        stack = [(self.root, 0, 0)] if self.root and len(probe) else []
        while stack:
            (edge, depth, ends, children, least, most), overlap, used = stack.pop()
            if len(edge):
                at = np.searchsorted(probe, edge)
                match = probe[np.minimum(at, len(probe) - 1)] == edge
                if first and not overlap and match.any() and edge[match.argmax()] < first:
                    continue
                overlap += int(match.sum())
                used = int(np.searchsorted(probe, edge[-1], "right"))
                # Members beyond the probe's last known one may still match what follows it.
                depth += len(edge) if edge[-1] <= probe[-1] else int(np.searchsorted(edge, probe[-1], "right"))
            left = size - lone - used
            if 9 * (overlap + min(left, most - depth)) < 4 * (size + least):
                continue
            found.extend(self.order[i] for i in ends if 9 * (overlap + min(left, self.rest[i] - depth)) >= 4 * (size + self.sizes[i]))
            stack.extend((c, overlap, used) for c in children)
        return found


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for lo, hi in blocks(texts, 1_000_000):
            got = [np.unique(h).tobytes() for h in shingle_hashes(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(got, pa.binary())], names=["rep", "items"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, block, b is not null): a centre's set, then its partners'; out: the links (a, b)."""
    key, probe = None, None
    ids: list[int] = []
    sets: list[np.ndarray] = []

    def close() -> list[tuple[int, int]]:
        if probe is None or not sets:
            return []
        return [(key[0], ids[i]) for i in Trie(sets).linked(probe)]

    out: list[tuple[int, int]] = []
    for batch in batches:
        for a, block, b, items in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "items")), strict=True):
            if (a, block) != key:
                out += close()
                key, probe, ids, sets = (a, block), None, [], []
            if b is None:
                probe = np.frombuffer(items, np.uint64)
            elif not ids or ids[-1] != b:
                ids.append(b)
                sets.append(np.frombuffer(items, np.uint64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out = []
    out = close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _links(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents link. ``rows``: doc_id, text of all nodes."""
    need = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(join_small(rows, need, "doc_id", "left_semi").mapInArrow(_set_rows, "rep long, items binary"), "sets", TEXT_ROWS)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    members = dealt.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "block", "b", "items")
    spread = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    probes = spread.join(sets.withColumnRenamed("rep", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "items")
    dealt = probes.unionByName(members).repartition(partitions(rows.sparkSession), "a", "block")
    out = materialize(dealt.sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(_verify, "a long, b long"), "links")
    release(sets)
    return out


def _possible(a: str, b: str) -> F.Column:
    """Length and position bounds of two postings (structs of rep, n, pos) of the first shingle that a pair shares.

    What comes before it matches nothing, so the overlap is at most what is left of either set. A linked
    pair passes at its first shared shingle; at others it need not.
    """
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    most = F.least(na - pa_, nb - pb)
    return (F.col(f"{a}.rep") != F.col(f"{b}.rep")) & (9 * most >= 4 * (na + nb))


def _ordered(p: str, q: str) -> list[F.Column]:
    return [F.least(f"{p}.rep", f"{q}.rep").alias("a"), F.greatest(f"{p}.rep", f"{q}.rep").alias("b")]


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their node, of the shingles whose nodes have several."""
    if labels is None:
        return postings.withColumn("label", F.col("rep"))
    own = postings.join(labels, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    open_ = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return materialize(own.join(open_, "key"), "open")


def _pivot_pairs(own: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of nodes with ``most`` pivots of their shingle (each of another component, those with the fewest own shingles)."""
    best = own.groupBy("key", "label").agg(F.min(F.struct("own", "rep", "n", "pos")).alias("q"))
    if most == 1:
        best = best.groupBy("key").agg(F.min("q").alias("q"))
    else:
        best = best.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("q"))).where(F.col("k") <= most).select("key", "q", F.col("label").alias("label2"))
    both = own.select("key", "label", F.struct("rep", "n", "pos").alias("p")).join(best, "key").where(_possible("p", "q"))
    return (both if most == 1 else both.where("label != label2")).select(*_ordered("p", "q")).distinct()


def _pairs_of_few(own: DataFrame) -> DataFrame:
    p, q = F.struct("rep", "n", "pos"), F.struct("rep", "n", "pos")
    left, right = own.select("key", "label", p.alias("p")), own.select("key", F.col("label").alias("label2"), q.alias("q"))
    both = left.join(right, "key").where((F.col("label") != F.col("label2")) & (F.col("p.rep") < F.col("q.rep")) & _possible("p", "q"))
    return both.select(*_ordered("p", "q")).distinct()


def _beginning_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, other, side): pairs of a block with another that their beginnings allow."""
    now, sides = None, ([], [])

    def close() -> list[tuple[int, int]]:
        a, b = sides
        if not a:
            return []
        same = now[1] == now[2]
        held = a if same else b
        if not held:
            return []
        trie = Trie([x[4] for x in held], [x[2] for x in held], [x[3] for x in held])
        seq = a[0][4]
        first = int(seq[(seq & np.uint64(_MASK)) == np.uint64(now[0])][0])
        out = []
        for rep, label, n, lone, seq in a:
            for i in trie.linked(seq, n, lone, first):
                rep2, label2 = held[i][:2]
                if label != label2 and (not same or rep < rep2):
                    out.append((min(rep, rep2), max(rep, rep2)))
        return out

    out: list[tuple[int, int]] = []
    for batch in batches:
        for key, block, other, side, rep, label, n, lone, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, block, other) != now:
                out += close()
                now, sides = (key, block, other), ([], [])
            sides[side].append((rep, label, n, lone, np.frombuffer(seq, np.uint64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out = []
    out = close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's posted shingles (class, key) as ascending numbers, rarest first."""
    for b in batches:
        seqs = []
        for tokens in b.column("tokens").to_pylist():
            seqs.append(np.sort(np.array([t["class"] << _KEY_BITS | t["key"] for t in tokens], np.uint64)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(seqs, pa.binary())], names=["rep", "seq"])


def _pairs_of_many(own: DataFrame, postings: DataFrame) -> DataFrame:
    need = own.select("rep").distinct()
    seqs = postings.join(need, "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("class", "key")).alias("tokens"))  # of one node
    rows = own.join(seqs.mapInArrow(_sequence, "rep long, seq binary"), "rep")
    rows = rows.withColumn("m", F.ceil(F.col("k") / BLOCK)).withColumn("at", F.pmod(F.xxhash64("rep"), F.col("m")))
    cols = ["rep", "label", "n", "lone", "seq"]
    left = rows.select("key", F.col("at").alias("block"), F.explode(F.sequence(F.col("at"), F.col("m") - 1)).alias("other"), F.lit(0).alias("side"), *cols)
    right = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("block"), F.col("at").alias("other"), F.lit(1).alias("side"), *cols).where("block != other")
    dealt = left.unionByName(right).repartition(partitions(own.sparkSession), "key", "block", "other").sortWithinPartitions("key", "block", "other", "side")
    return dealt.mapInArrow(_beginning_pairs, "a long, b long").distinct()


def _pairs_across(own: DataFrame, postings: DataFrame) -> DataFrame:
    """All possible pairs (a, b) of one shingle whose nodes have different labels."""
    sized = materialize(own.join(own.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key"), "sized")
    many = sized.where(F.col("k") > FEW)
    few = _pairs_of_few(sized.where(F.col("k") <= FEW))
    if not many.limit(1).count():
        return few
    return few.unionByName(_pairs_of_many(many, postings)).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = materialize(rows.mapInArrow(_signatures, "doc_id long, n long, fp binary"), "sigs", TEXT_ROWS)
    full = sigs.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("fp", "n").agg(F.min("doc_id").alias("rep")), "reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    parts = partitions(spark)
    buckets = max(parts, -(-total // 1_500_000))
    if buckets > 1 << (_KEY_BITS - 32):
        raise ValueError(f"{total} shingles are more than the keys can tell apart")
    nodes = rows.join(reps.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    packed = nodes.mapInArrow(_packed_shingles(buckets), "bucket int, low binary, who binary, reps binary")
    shared = packed.repartition(max(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(), "rep long, key long, df long")
    shared = materialize(shared, "shared", TEXT_ROWS)

    head = reps.groupBy("rep").agg(F.max("n").alias("n"))
    by = Window.partitionBy("rep")
    shared_ = shared.select("rep", "key", F.least(F.floor(8 * F.log2("df")), F.lit(CLASSES - 1)).cast("long").alias("class"))
    placed = shared_.join(head, "rep").select(
        "rep", "key", "class", "n",
        (F.col("n") - F.count(F.lit(1)).over(by)).alias("lone"),
        F.row_number().over(by.orderBy("class", "key")).alias("rank"),
    )
    size = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    placed = placed.select("rep", "key", "n", (F.col("lone") + F.col("rank") - 1).alias("pos"), (F.col("lone") / F.col("n")).alias("own"), "lone", "class", size.alias("size"))
    postings = materialize(placed.where("pos < size").drop("size"), "postings")
    release(shared)

    links: DataFrame | None = None
    tried: DataFrame | None = None
    labels: DataFrame | None = None
    for most in (*PIVOTS, None):
        own = _labelled(postings, labels)
        pairs = _pivot_pairs(own, most) if most else _pairs_across(own, postings)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        new = _links(rows, pairs)
        links = new if links is None else links.unionByName(new)
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = materialize(connected_components(links).withColumnRenamed("node", "rep"), "labels")
    named = reps.select("fp", "n", "rep")
    if labels is not None:
        named = named.join(labels, "rep", "left")
    else:
        named = named.withColumn("component", F.col("rep"))
    named = named.select("fp", "n", F.coalesce("component", "rep").alias("component"))
    out = sigs.join(named, ["fp", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))
