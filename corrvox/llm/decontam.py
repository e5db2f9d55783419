r"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are taken as words (``[^\x20\x09-\x0D]+``, A-Z lower-cased). Fixed masks pick some of the
positions of a short span and ignore the others, so a replaced word leaves the hashes of the spans
whose ignored positions it falls on. Training hashes are joined with the benchmark's; each
(document, item, shift) with enough hits is verified: the item is laid over the document at that
shift, and the overlap counts if some ``window`` aligned words (the item's length if shorter) have
at least ``share`` of them equal.

Masks are chosen by the item's length so that every window that passes is hit (``plan_masks``
enumerates the places of replaced words), and an item asks for as many hits on one shift as every
passing window has. So the result is exactly what laying every item over every position would
give, for items of any length: those under 5 words match verbatim only, as the share demands.

A row is told by its identifier and text together, so rows that repeat an identifier are judged
each by its own text, and rows with a null identifier are judged too. Null or empty texts and
items match nothing. Repeated rows of a document give one row. Texts of any length are read whole.
Empty tables give an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Families of masks, the most selective first; the first that hits every passing window is used. ``plan_masks`` has a last resort.
FAMILIES = (("1101111", "110010111"), ("11011", "1111"), ("1111", "11011", "10111", "11101"))
_KEY = "_decontam_key"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty give an empty array."""
    flat = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"[\x20\x09-\x0D]+"))


def need_of(wide: int, share: float) -> int:
    return max(1, math.ceil(wide * share - 1e-9))


def least_hits(wide: int, need: int, masks: tuple[str, ...]) -> int:
    """How many hits (mask and place) every window of ``wide`` words has of which ``need`` are equal."""
    spots = [sum(1 << (at + k) for k, c in enumerate(m) if c == "1") for m in masks for at in range(wide - len(m) + 1)]
    lost = (sum(1 << k for k in out) for out in itertools.combinations(range(wide), wide - need))
    return min(sum(not s & x for s in spots) for x in lost)


def plan_masks(n_words: int, window: int = 13, share: float = 0.8) -> tuple[tuple[str, ...], int]:
    """Masks for items of ``n_words`` words, and how many hits a passing shift has at least (one or more)."""
    wide = min(window, n_words)
    need = need_of(wide, share)
    if math.comb(wide, wide - need) <= 5_000:
        for masks in FAMILIES:
            hits = least_hits(wide, need, masks)
            if hits:
                return masks, hits
    # The replaced words cut the window into wide - need + 1 runs; the longest has this many words.
    return ("1" * -(-need // (wide - need + 1)),), 1


def seed_hashes(hashes: Column, masks: tuple[str, ...]) -> Column:
    """At every position an array of the masks' hashes, from the array of the words' hashes.

    Where a span doesn't fit its hash covers fewer words; no item has such a seed.
    """
    keep = {m: [k for k, c in enumerate(m) if c == "1"] for m in masks}
    return F.transform(hashes, lambda x, i: F.array(*[F.xxhash64(F.lit(m), x, *[F.get(hashes, i + k) for k in keep[m][1:]]) for m in masks]))


def _seeds(items: DataFrame, window: int, share: float) -> tuple[DataFrame | None, tuple[str, ...]]:
    """(hash, item_id, item_row, item_pos, hits) of every seed of every item, and the masks that occur."""
    lengths = [r["n"] for r in items.select(F.least("n_words", F.lit(window)).alias("n")).where("n > 0").distinct().collect()]  # ``window`` rows at most
    plans = {n: plan_masks(n, window, share) for n in lengths}
    parts = []
    for masks, hits in sorted(set(plans.values())):
        own = sorted(n for n, p in plans.items() if p == (masks, hits))
        rows = items.where(F.least("n_words", F.lit(window)).isin(own))
        for m in masks:
            hashed = rows.select("item_id", "item_row", "n_words", F.posexplode(seed_hashes(F.col("hashes"), (m,))).alias("item_pos", "of_mask"))
            parts.append(hashed.where(F.col("item_pos") + len(m) <= F.col("n_words")).select(F.get("of_mask", F.lit(0)).alias("hash"), "item_id", "item_row", "item_pos", F.lit(hits).alias("hits")))
    if not parts:
        return None, ()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, tuple(sorted({m for masks, _ in plans.values() for m in masks}))


def _overlaps(docs: DataFrame, bench: DataFrame, window: int, share: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """key, doc_id, item_id, start_word, n_words, n_equal of every (row, item, shift) that passes; ``key`` tells rows by identifier and text."""
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("item_words"))
    items = items.select("*", F.xxhash64("item_id", "item_words").alias("item_row"), F.size("item_words").alias("n_words"), F.transform("item_words", lambda w: F.xxhash64(w)).alias("hashes"))
    items = materialize(items.dropDuplicates(["item_row"]), "items")
    seeds, masks = _seeds(items, window, share)
    schema = "key long, doc_id long, item_id long, start_word int, n_words int, n_equal int"
    if seeds is None:
        return docs.sparkSession.createDataFrame([], schema)
    seeds = materialize(seeds, "seeds")
    # Every word is hashed once; the masks' hashes are made of these numbers. Only the key goes along with a position.
    hashed = rows.select("key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    own = hashed.select("key", F.posexplode(seed_hashes(F.col("h"), masks)).alias("pos", "of_mask")).select("key", "pos", F.explode("of_mask").alias("hash"))
    hits = join_small(own, seeds, "hash").groupBy("key", "item_row", "item_id", "hits", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n_hits"))
    hits = materialize(hits.where("n_hits >= hits").select("key", "item_row", "item_id", "shift"), "hits")

    mine = join_small(rows, hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    laid = join_small(mine.select("key", "doc_id", words_of(F.col("text")).alias("words")), hits, "key")
    laid = join_small(laid, items.select("item_row", "item_words"), "item_row", most=20_000)
    size = F.size("item_words")
    wide = F.least(F.lit(window), size)
    equal = F.transform("item_words", lambda w, j: F.coalesce((F.when(F.col("shift") + j >= 0, F.get(F.col("words"), F.col("shift") + j)) == w).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("wide")), lambda s: F.aggregate(F.slice(F.col("equal"), s + 1, F.col("wide")), F.lit(0), lambda a, x: a + x))
    need = F.greatest(F.lit(1), F.ceil(F.col("wide") * F.lit(share) - F.lit(1e-9)))
    laid = laid.select("key", "doc_id", "item_id", "shift", equal.alias("equal"), wide.alias("wide")).select("*", sums.alias("sums"))
    passing = F.filter(F.transform("sums", lambda x, s: F.when(x >= need, s)), lambda s: s.isNotNull())
    found = laid.select("key", "doc_id", "item_id", "shift", "wide", "equal", passing.alias("at")).where(F.size("at") > 0)
    return found.select(
        "key", "doc_id", "item_id",
        (F.col("shift") + F.array_min("at")).alias("start_word"),
        (F.array_max("at") - F.array_min("at") + F.col("wide")).alias("n_words"),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("n_equal"),
    )


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 13, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, start_word, n_words, n_equal (at the best shift)."""
    found = _overlaps(docs, bench, window, share, id_col, text_col, item_col, item_text_col)
    best = F.struct(F.col("n_equal"), F.col("n_words"), (-F.col("start_word")).alias("neg_start"))
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m")).select("doc_id", "item_id", (-F.col("m.neg_start")).cast("int").alias("start_word"), F.col("m.n_words").alias("n_words"), F.col("m.n_equal").alias("n_equal"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 13, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps an item of ``bench``; all its columns."""
    found = _overlaps(docs, bench, window, share, id_col, text_col, item_col, item_text_col)
    bad = materialize(found.select(F.col("key").alias(_KEY)).distinct(), "leaks")
    return join_small(docs.withColumn(_KEY, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))), bad, _KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(window: int = 13, share: float = 0.8) -> str:
    """The same rows by laying items over documents at every shift that shares a word."""
    split = r"string_split(trim(regexp_replace(translate(coalesce({t}, ''), '%s', '%s'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')" % (UPPER, LOWER)
    return f"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {split.format(t="text")} AS w FROM documents)),
i AS (SELECT item_id, w, least({window}, len(w)) AS wide FROM (SELECT item_id, {split.format(t="text")} AS w FROM benchmark)),
b AS (SELECT item_id, len(w) AS size, wide, CAST(greatest(1, ceil(wide * {share} - 1e-9)) AS INT) AS need, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM i),
e AS (SELECT d.doc_id, b.item_id, b.size, b.wide, b.need, d.pos - b.pos AS shift, b.pos AS p FROM d JOIN b USING (word) WHERE word <> ''),
few AS (SELECT doc_id, item_id, shift FROM e GROUP BY ALL HAVING count(DISTINCT p) >= any_value(need)),
f AS (SELECT DISTINCT e.* FROM e JOIN few USING (doc_id, item_id, shift)),
spots AS (SELECT doc_id, item_id, shift, wide, need, s FROM (SELECT DISTINCT doc_id, item_id, shift, size, wide, need FROM f), generate_series(0, size - wide) g(s)),
ok AS (SELECT a.doc_id, a.item_id, a.shift, a.s, a.wide FROM spots a JOIN f ON a.doc_id = f.doc_id AND a.item_id = f.item_id AND a.shift = f.shift AND f.p BETWEEN a.s AND a.s + a.wide - 1 GROUP BY ALL HAVING count(*) >= any_value(a.need)),
n AS (SELECT doc_id, item_id, shift, count(*) AS n_equal FROM f GROUP BY ALL),
r AS (SELECT doc_id, item_id, shift, shift + min(s) AS start_word, max(s) - min(s) + any_value(wide) AS n_words, any_value(n_equal) AS n_equal FROM ok JOIN n USING (doc_id, item_id, shift) GROUP BY doc_id, item_id, shift)
SELECT doc_id, item_id, start_word, n_words, n_equal FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words DESC, start_word) = 1"""
