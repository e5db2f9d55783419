"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

* **Language model**: counts of character trigrams over all documents (bytes folded to 64 classes),
  gathered by every task for itself and summed by cell, so they grow with the input while the
  driver sees 64**3 numbers at most.
* **Channel**: a token that can be disguised (symbols or digits next to letters, also last ones, a
  letter three times, three or more single letters or symbols set apart, a letter among them) becomes a lattice of characters: each symbol may stand for the
  letters it resembles, a run may be one letter or two, separators may go. Viterbi decoding finds
  the path that is likeliest under the language model and the channel's costs. All other tokens
  have one path, themselves.
* **Score**: words and word beginnings learned by sequential covering on labelled documents: again
  and again the feature that explains most toxic documents not yet explained, as long as few clean
  ones have it; then those that no clean document has and that toxic ones have far beyond chance. A document's score is the precision (smoothed, at the rate of all labels) of its
  features taken together (one minus the product of their failures); without a feature it is the rate
  of toxic documents that no feature explains.

The classifier is fitted on at most ``per_class`` labelled documents of each label, no longer than
``FIT_CHARS`` characters (a bounded sample; scoring reads every whole text). Features are counted by
Spark; the driver gets those of three toxic documents or more, and their numbers for each document.
Null and empty texts get the score of a text without features. If nothing is labelled, scores are 0.
Repeated rows get a row each; of a labelled identifier with several texts the first in order is
learned, of several labels the highest. Labels without an identifier or a value are not read; rows
with a null identifier are scored and never held out. Empty tables give an empty result. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize, release

CLASSES = 64
FIT_CHARS = 20_000

# What a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = " .-_*"

_SYMBOL = "0-9@$!|+€"
_TRIGGER = re.compile(rf"[{_SYMBOL}][^\W\d_]|[^\W\d_][{_SYMBOL}]*[0-9@$][!|+]*(?![{_SYMBOL}]|[.@]?\w)|([^\W\d_])\1\1", re.I)
_UNIT = rf"(?:[^\W\d_]|[{_SYMBOL}])"
_APART = re.compile(rf"(?<![^\W_]){_UNIT}(?:[ .\-_*]{_UNIT}){{2,}}(?![^\W_])")
_LETTER = re.compile(r"[^\W\d_]")
_CORE = re.compile(rf"[^\W\d_{_SYMBOL}]|[{_SYMBOL}]")
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")

_FOLD = np.zeros(256, np.uint8)  # class 0: all that isn't a letter
for _b in range(26):
    _FOLD[97 + _b] = _FOLD[65 + _b] = 1 + _b
_FOLD[128:] = 27 + (np.arange(128) % 37)


def fold(text: str) -> list[int]:
    return _FOLD[np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)].tolist()


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of trigrams of folded bytes over all texts (each with a space at both ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                data = " ".join(["", *(t for t in b.column("text").slice(k, 500).to_pylist() if t), ""]).encode("utf-8", "ignore")
                c = _FOLD[np.frombuffer(data, np.uint8)].astype(np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell int, n long")
    out = np.zeros(CLASSES**3, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


#: The last language model that this worker process got, so its tasks share one.
_tables: list[tuple[bytes, list]] = []


class Channel:
    """The character language model and the lattice decoder."""

    SWAP, KEEP_SYMBOL, ONE_OF_RUN, ONE_OF_TWO, TWO_OF_RUN, DROP_GAP = -0.7, -6.0, -0.5, -2.5, -0.3, -0.7

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        uni = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * CLASSES)
        bi = c.sum(0)
        bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
        tri = (c + 5 * bi[None]) / (c.sum(2, keepdims=True) + 5)
        self.table = np.log(tri)
        self.log = self.table.tolist()
        self.memo: dict[str, str] = {}

    def __getstate__(self) -> bytes:
        return self.table.tobytes()  # 2 MB, whatever the input

    def __setstate__(self, state: bytes) -> None:
        self.table = np.frombuffer(state).reshape(CLASSES, CLASSES, CLASSES)
        if not any(t == state for t, _ in _tables):
            _tables[:] = [(state, self.table.tolist())]
        self.log, self.memo = _tables[0][1], {}

    def _edges(self, c: str, i: int, j: int) -> list[tuple[int, str, float]]:
        """(next place, what is emitted, cost) from place ``i``, in a run of ``c`` that ends before ``j``."""
        if c in SEPARATORS:
            return [(i + 1, "", self.DROP_GAP), (i + 1, c, 0.0)]
        out = [(i + 1, c, 0.0 if c not in LEET else self.KEEP_SYMBOL)]
        out += [(i + 1, x, self.SWAP) for x in LEET.get(c, "")]
        if j - i > 1:
            for x in LEET.get(c, c):
                cost = (self.ONE_OF_RUN if j - i > 2 else self.ONE_OF_TWO) + (self.SWAP if c in LEET else 0.0)
                out += [(j, x, cost), (j, x + x, cost + self.TWO_OF_RUN)]
        return out

    def decode(self, token: str) -> str:
        """The likeliest reading of a token, in lower case; symbols at its ends that aren't letters stay."""
        if token in self.memo:
            return self.memo[token]
        s = token.lower()
        spots = [m.start() for m in _CORE.finditer(s)]
        if not spots:
            return token
        a, z = spots[0], spots[-1] + 1
        while z - 1 > a and s[z - 1] in "!|+":
            z -= 1
        core, log = s[a:z], self.log
        ends_at = list(range(1, len(core) + 1))  # of the run that each place is in
        for i in range(len(core) - 2, -1, -1):
            if core[i] == core[i + 1]:
                ends_at[i] = ends_at[i + 1]
        # Best by place and last two classes: (log probability, last piece of text, the state before). Places that are done
        # are given up, so only states on a path that still leads on are held.
        best: list[dict[tuple[int, int], tuple] | None] = [{} for _ in range(len(core) + 1)]
        best[0][(0, 0)] = (0.0, "", None)
        for i in range(len(core)):
            states, best[i] = best[i], None
            if not states:
                continue
            edges = [(j, x, fold(x), cost) for j, x, cost in self._edges(core[i], i, ends_at[i])]
            for (p, q), state in states.items():
                for j, x, classes, cost in edges:
                    u, v, now = p, q, state[0] + cost
                    for k in classes:
                        now += log[u][v][k]
                        u, v = v, k
                    old = best[j].get((u, v))
                    if old is None or now > old[0]:
                        best[j][(u, v)] = (now, x, state)
        ends = []
        for (u, v), state in best[-1].items():
            total, pieces = state[0] + log[u][v][0], []
            while state is not None:
                pieces.append(state[1])
                state = state[2]
            ends.append((total, "".join(reversed(pieces))))
        out = s[:a] + max(ends)[1] + s[z:]
        if len(s) > 200:
            return out  # not kept
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token] = out
        return out

    def restore(self, text: str) -> str:
        """The text with every disguised token decoded."""
        spans = [m.span() for m in _APART.finditer(text) if _LETTER.search(m[0])]
        at = 0
        for m in _TRIGGER.finditer(text):
            if m.start() < at:
                continue
            a = m.start()
            while a and not text[a - 1].isspace():
                a -= 1
            g = _GAP.search(text, m.end())
            at = g.start() if g else len(text)
            spans.append((a, at))
        if not spans:
            return text
        out, at = [], 0
        for a, z in sorted(spans):
            if a >= at:
                out += [text[at:a], self.decode(text[a:z])]
                at = z
        return "".join([*out, text[at:]])


BEGINNINGS = (4, 5, 6)


def features(restored: str) -> set[str]:
    """Its words, and the beginnings of its words (with a mark)."""
    words = set(_WORD.findall(restored.lower()))
    return words.union(*({f"{w[:n]}~" for w in words if len(w) >= n} for n in BEGINNINGS))


@dataclass
class Scorer:
    base: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, restored: str) -> float:
        words = set(_WORD.findall(restored.lower()))
        own = self.weights.keys() & words
        for n in BEGINNINGS:
            own |= self.weights.keys() & {f"{w[:n]}~" for w in words if len(w) >= n}
        if not own:
            return self.base
        rest = 1.0
        for p in sorted(self.weights[w] for w in own):
            rest *= 1 - p
        return max(0.0, min(1.0, 1 - rest))


_MIX = (1, 2654435761, 40503, 97531)  # four orders of hashes


def min_hashes(words: set[str]) -> list[int]:
    """The least of each order of the features' hashes; without features none."""
    h = np.array([zlib.crc32(f.encode()) for f in words], np.uint64)
    return [int((h * np.uint64(m) % np.uint64(4294967291)).min()) for m in _MIX] if len(h) else []


def _kinds(hashes: list[list[int]]) -> list[int]:
    """A number for each document; documents that share one of their min-hashes share the number."""
    root = list(range(len(hashes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, own in enumerate(hashes):
        for key in enumerate(own):
            root[find(i)] = find(seen.setdefault(key, i))
    return [find(i) for i in range(len(hashes))]


@dataclass
class Sample:
    """Counts of a sample of labelled documents."""

    names: list[str]  # features that LEAST toxic documents have, or more
    bad: np.ndarray  # how many toxic documents have each
    good: np.ndarray  # and how many clean ones
    have: list[np.ndarray]  # for each toxic document the numbers of its features among ``names``
    hashes: list[list[int]]  # for each toxic document its min-hashes
    rest: dict[int, int]  # of all other features: how many are in so many documents
    n_clean: int


LEAST = 3


def fit_scorer(sample: Sample, rate: float, precision: float = 0.9) -> Scorer:
    """Sequential covering. ``rate``: share of toxic among all labelled documents."""
    n_toxic, n_clean = len(sample.have), sample.n_clean
    if not n_toxic:
        return Scorer(0.0)
    if not n_clean:
        return Scorer(1.0)
    names, bad, good = sample.names, sample.bad, sample.good
    at_rate = (1 - rate) * n_toxic / (rate * n_clean)  # clean documents count so many
    exact = (bad + rate) / (bad + good * at_rate + 1)
    holders: list[list[int]] = [[] for _ in names]
    for i, own in enumerate(sample.have):
        for f in own.tolist():
            holders[f].append(i)
    able = exact >= precision
    left = np.where(able, bad, 0)
    ties = np.lexsort((names, [-len(x) for x in names], exact)) if names else np.zeros(0, np.int64)
    place = np.empty(len(names), np.int64)
    place[ties] = np.arange(len(names))  # of equal gain the more precise, then the shorter
    open_ = np.ones(n_toxic, bool)
    chosen: dict[str, float] = {}
    while left.any():
        gain = np.where(left >= LEAST, left - 3 * good, -1)
        f = int(np.lexsort((place, gain))[-1])
        if gain[f] < LEAST:
            break
        chosen[names[f]] = float(exact[f])
        for i in holders[f]:
            if open_[i]:
                open_[i] = False
                np.subtract.at(left, sample.have[i], able[sample.have[i]].astype(left.dtype))
        left[f] = 0
    # Features that never stand alone are not needed for covering, but may stand alone elsewhere: those that no
    # clean document has, if at most a fiftieth of the features with as many toxic documents would be there by
    # chance. Copies (documents that share one of four min-hashes) count once.
    # With one min-hash for each document instead, a feature is taken where chance is out of the question.
    kinds, low = _kinds(sample.hashes), [h[0] if h else 0 for h in sample.hashes]
    enough = 20 / math.log((n_toxic + n_clean) / n_toxic)
    chance = len(set(kinds)) / (len(set(kinds)) + n_clean)
    spread = [len({kinds[i] for i in h}) for h in holders]
    seen = Counter(sample.rest)
    seen.update(n + int(g) for n, g in zip(spread, good, strict=True))
    alone = Counter(n for n, g in zip(spread, good, strict=True) if not g)
    for f, n in enumerate(spread):
        likely = able[f] and len({low[i] for i in holders[f]}) >= enough
        if names[f] not in chosen and not good[f] and (likely or n > 2 and seen[n] * chance**n <= 0.02 * alone[n]):
            chosen[names[f]] = float(exact[f])
    share = int(open_.sum()) / n_toxic
    return Scorer(rate * share / (rate * share + 1 - rate), chosen)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, channel: Channel, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Scorer(0.0)
    pieces = []
    for y, n in sorted(counts.items()):
        share = min(1.0, (1.5 * per_class + 200) / n)
        unit = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
        pieces.append(known.where((F.col("y") == y) & (unit < share)))
    near = pieces[0]
    for p in pieces[1:]:
        near = near.unionByName(p)
    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id"))).where(F.col("rank") <= per_class)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text").between(1, FIT_CHARS))
    got = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # two classes x per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                own = [features(channel.restore(t)) for t in part.column("text").to_pylist()]
                cols = [part.column("doc_id"), part.column("y"), pa.array([min_hashes(f) for f in own], pa.list_(pa.int64())), pa.array([list(f) for f in own], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "hashes", "features"])

    rows = materialize(got.mapInArrow(run, "doc_id long, y int, hashes array<long>, features array<string>"), "features")
    each = rows.select("doc_id", "y", F.explode("features").alias("f"))
    toxic = F.col("y") == 1
    by = materialize(each.groupBy("f").agg(F.count(F.when(toxic, 1)).alias("bad"), F.count(F.when(~toxic, 1)).alias("good")), "counts")
    able = by.where(F.col("bad") >= LEAST).orderBy("f").collect()
    rest = {r["n"]: r["count"] for r in by.where(F.col("bad") < LEAST).groupBy((F.col("bad") + F.col("good")).alias("n")).count().collect()}
    names = [r["f"] for r in able]
    number = {f: k for k, f in enumerate(names)}
    numbered = join_small(each.where(toxic), by.where(F.col("bad") >= LEAST).select("f"), "f", "left_semi").groupBy("doc_id").agg(F.collect_list("f").alias("fs"))
    have = {r["doc_id"]: np.array([number[f] for f in r["fs"]], np.int64) for r in numbered.toLocalIterator()}
    docs_of = rows.select("doc_id", "y", "hashes").orderBy("doc_id").collect()
    release(rows)
    release(by)
    sample = Sample(
        names, np.array([r["bad"] for r in able], np.int64), np.array([r["good"] for r in able], np.int64),
        [have.get(r["doc_id"], np.zeros(0, np.int64)) for r in docs_of if r["y"] == 1], [r["hashes"] for r in docs_of if r["y"] == 1],
        rest, sum(r["y"] == 0 for r in docs_of),
    )
    total = counts.get(0, 0) + counts.get(1, 0)
    return fit_scorer(sample, counts.get(1, 0) / max(1, total))


def score_documents(docs: DataFrame, channel: Channel, scorer: Scorer, restored: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and, if asked for, the restored text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                texts = [channel.restore(t or "") for t in part.column("text").to_pylist()]
                cols = [part.column("doc_id"), pa.array([scorer.score(t) for t in texts], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * restored, names=["doc_id", "score"] + ["restored"] * restored)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double" + ", restored string" * restored)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from labels that aren't held out."""
    channel = Channel(trigram_counts(docs))
    scorer = fit(docs, labels.where(~held_out(F.col("doc_id"))), channel, **kw)
    out = score_documents(docs, channel, scorer)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
