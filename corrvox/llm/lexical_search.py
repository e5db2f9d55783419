r"""Ranked lexical search over a tiered index.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased. The score of a
document for an item is the sum over the item's terms, once each, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``: a
posting's *impact*, which does not depend on the item.

**Index.** One pass over the texts writes a forward table (a row for each document: its length, its terms and their counts).
A histogram of impacts by term, in 245 steps, cuts each term's postings into tiers: the first tier holds the steps of
highest impact as long as they have at most ``first`` postings, the next one ``growth`` times as many, until the last tier
holds the longest list to its end. Every posting is in one tier; the postings lie in a folder for each tier. A term has a
residual bound for each tier: the highest impact that it still has below.

**Search.** Round j reads tiers 0 to j for the items that have no proof yet and adds what it finds up to a lower bound for
each (item, document). Let T be an item's k-th best lower bound and U the sum of its terms' residual bounds. Where T > U, no
document that was not seen can enter, and of those seen only the ones whose bound reaches T can; where U is 0, all
postings were read. Items without such a proof fall through to the next tier by themselves; the last tier proves all.
What can enter is then scored in full from the forward table. The result is exact.

Nothing is grouped by term alone but counts, so a term that every document holds is no hot group. Documents that hold the
same text are all scored; equal scores are ordered by identifier. Sides are broadcast when measured to be small.

Null, empty and wordless texts hold no terms and do not count in N. Rows are documents: repeated rows are ranked each. Rows of
the items that repeat an identifier are one item with all their terms; an item with a null identifier is an item. Rows of equal score
and identifier come in any order. Very long texts are read whole, one row at a time in memory. Empty tables give an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize, new_path, release, small

FIRST, GROWTH = 2048, 8
STEP = 12  # impacts without their weight, at most 10**6, are counted in steps of 2**STEP

#: Bytes of a term as they are, A-Z lower-cased, all others a space.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _forward(vocabulary: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            lengths, names, counts = [], [], []
            for t in texts:
                words = terms_of(t.as_py() or b"")
                held = Counter(words)
                if vocabulary is not None:
                    held = {w: c for w, c in held.items() if w in vocabulary}
                lengths.append(len(words))
                names.append(list(held))
                counts.append(list(held.values()))
            ends = [0]
            for x in names:
                ends.append(ends[-1] + len(x))
            ends = pa.array(ends, pa.int32())
            terms = pa.array(chain.from_iterable(names), pa.binary()).cast(pa.string())
            tfs = pa.array(chain.from_iterable(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)], names=["row", "doc_id", "n", "terms", "tfs"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term), once each; ``item`` is a key that is never null."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.explode(F.split(lowered, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    return items.select(key.alias("item"), F.col(id_col).alias("item_id"), words.alias("term")).where("term != ''").distinct()


@dataclass
class Index:
    forward: DataFrame  # row, doc_id, n, terms, tfs
    postings: DataFrame  # tier, term, row, impact
    terms: DataFrame  # term, weight, rest (residual bound below each tier)
    tiers: int
    impact: str  # SQL of a posting's impact without its weight, over n and tf


def build_index(docs: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> Index:
    """Index every row of ``docs``; ``asked`` (a column ``term``, distinct) leaves out the postings of terms that no item has, where it is small."""
    vocabulary = None
    if asked is not None and small(asked):
        vocabulary = frozenset(r[0].encode() for r in asked.select("term").collect())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    forward = materialize(rows.mapInArrow(_forward(vocabulary), "row long, doc_id long, n long, terms array<string>, tfs array<long>"), "forward")
    total = forward.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("words")).first()
    impact = f"(1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {total['docs']}L) div {total['words']}L))"

    postings = forward.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).select("row", "term", F.expr(impact).alias("x"))
    step = F.shiftright("x", STEP).cast("int")
    steps = materialize(postings.groupBy("term", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")), "steps")
    longest = steps.groupBy("term").agg(F.sum("n").alias("df")).agg(F.max("df")).first()[0] or 0
    sizes = [first]
    while sizes[-1] < longest:
        sizes.append(sizes[-1] * growth)

    # At most 245 steps of a term meet in its window.
    down = Window.partitionBy("term").orderBy(F.desc("step"))
    upto = steps.withColumns({"upto": F.sum("n").over(down), "df": F.sum("n").over(Window.partitionBy("term"))})
    weight = F.floor(1000 * F.log((2 * F.lit(total["docs"]) + 2) / (2 * F.col("df") + 1))).cast("long")
    cuts = [F.coalesce(F.min(F.when(F.col("upto") <= s, F.col("step"))), F.lit(1 << 30)) for s in sizes[:-1]]
    rest = [F.coalesce(F.max(F.when(F.col("upto") > s, F.col("top"))), F.lit(0)) for s in sizes]
    terms = upto.groupBy("term").agg(F.first(weight).alias("weight"), F.array(*cuts, F.lit(0)).alias("cuts"), F.array(*rest).alias("rest"))
    terms = materialize(terms.withColumn("rest", F.transform("rest", lambda r: r * F.col("weight"))), "terms")

    tier = F.lit(0)
    for j in range(len(sizes) - 1):
        tier = tier + F.when(step < F.col("cuts")[j], 1).otherwise(0)
    path = new_path(docs.sparkSession, "tiers")
    tiered = join_small(postings, terms, "term").select("term", "row", (F.col("x") * F.col("weight")).alias("impact"), tier.alias("tier"))
    tiered.write.option("compression", "zstd").partitionBy("tier").parquet(path)
    kept = docs.sparkSession.read.schema("term string, row long, impact long, tier int").parquet(path)
    return Index(forward, kept, terms.select("term", "weight", "rest"), len(sizes), impact)


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """(item, rank, doc_id, score) of the ``k`` best documents of each item of ``asked`` (item, term)."""
    known = materialize(join_small(asked.select("item", "term"), index.terms, "term"), "asked")
    active, entrants = known, None
    best = Window.partitionBy("item").orderBy(F.desc("low"))
    for j in range(index.tiers):
        mine = active.select("item", "term", F.col("rest")[j].alias("left"))
        found = join_small(index.postings.where(F.col("tier") <= j), mine, "term")
        # Lower bound, and what was learnt beyond the residual bounds.
        seen = materialize(found.groupBy("item", "row").agg(F.sum("impact").alias("low"), F.sum(F.col("impact") - F.col("left")).alias("gain")), "seen")
        kth = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("item").agg(F.min("low").alias("kth"), F.count(F.lit(1)).alias("held"))
        state = mine.groupBy("item").agg(F.sum("left").alias("unseen")).join(kth, "item", "left")
        full = F.coalesce("held", F.lit(0)) >= k
        state = state.select("item", "unseen", F.when(full, F.col("kth")).otherwise(0).alias("least"))
        state = materialize(state.withColumn("proven", (F.col("unseen") == 0) | (F.col("least") > F.col("unseen"))), "state")
        can = join_small(seen, state.where("proven"), "item").where("unseen + gain >= least").select("item", "row")
        can = materialize(can, "entrants")
        release(seen)
        entrants = can if entrants is None else entrants.unionByName(can)
        active = join_small(active, state.where("not proven"), "item", "left_semi")
        if not state.where("not proven").limit(1).count():
            break
    return _in_full(index, known, entrants, k)


def _in_full(index: Index, known: DataFrame, entrants: DataFrame, k: int) -> DataFrame:
    rows = join_small(index.forward, entrants, "row").select("item", "row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    rows = rows.select("item", "row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    held = join_small(rows, known.select("item", "term", "weight"), ["item", "term"])
    scores = held.groupBy("item", "row", "doc_id").agg(F.sum(F.expr(f"weight * ({index.impact})")).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``k`` best documents with a score above 0."""
    asked = materialize(item_terms(items), "items")
    index = build_index(docs, asked.select("term").distinct(), first=first, growth=growth)
    found = search(index, asked, k)
    names = asked.select("item", "item_id").distinct()
    return join_small(found, names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{run}')) AS t FROM benchmark),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{run}') AS w FROM documents),
n AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM w WHERE len(w) > 0),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
d AS (SELECT t, count(*) AS df FROM f GROUP BY t),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * n_docs) // n_words))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN d USING (t) CROSS JOIN n GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10""".replace("{run}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def oracle_sql() -> str:
    return ORACLE_SQL
