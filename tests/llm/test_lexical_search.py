import math
import random
import re
from collections import Counter

import pytest

from corrvox.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n_docs, n_words = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, n in held:
            m = n and 10 + 90 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "A", "über", "Zoo", "x1", "日本", "it"] + [f"w{i}" for i in range(60)]
    text = lambda m: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, [60, 30, 10, 10, 5, 5, 20] + [1] * 60, k=m))
    docs = [(k, text(rng.randrange(0, 40))) for k in range(n)] + [(n + k, None if k == 0 else "" if k == 1 else " ,; ") for k in range(3)]
    hot = text(25)
    docs += [(1000 + k, hot) for k in range(n // 3)]
    return docs, [(k, text(rng.randrange(1, 12))) for k in range(8)] + [(50, hot), (51, None), (52, ""), (53, "nowhere"), (None, "w1 w2 the"), (None, "w3")]


@pytest.mark.parametrize(("seed", "first", "growth"), [(1, 2, 2), (2, 8, 4), (3, 2048, 8)])
def test_exact_whatever_the_tiers(spark, seed, first, growth):
    docs, items = corpus(seed, 90)
    got = L.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), first=first, growth=growth)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_items_fall_through_and_lists_are_cut(spark):
    docs, items = corpus(4, 90)
    asked = L.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = L.build_index(spark.createDataFrame(docs, "doc_id long, text string"), first=4, growth=4)
    by_tier = {r["tier"]: r["count"] for r in index.postings.groupBy("tier").count().collect()}
    assert index.tiers > 2 and min(by_tier) == 0 and sum(by_tier.values()) == sum(len(set(words(t))) for _, t in docs)
    most = index.postings.where("tier = 0").groupBy("term").count().agg({"count": "max"}).first()[0]
    assert most <= 4
    got = {(r.item, r.rank, r.doc_id, r.score) for r in L.search(index, asked).collect()}
    assert {(i, r, d, s) for i, r, d, s in brute(docs, items)} == {(None if i == "-" else int(i[1:]), r, d, s) for i, r, d, s in got}


def test_repeated_rows_long_texts_and_extra_columns(spark):
    docs = [(1, "cat dog"), (1, "cat dog"), (None, "cat"), (2, "dog " * 50_000), (3, "bird")]
    df = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n int, term string")
    items = [(1, "cat"), (2, "DOG")]
    got = L.rank_documents(df, spark.createDataFrame([(*r, "x", 5) for r in items], "item_id long, text string, term string, rank int"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    ask, nobody = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.rank_documents(none, ask).collect() == [] and L.rank_documents(one, nobody).collect() == []
