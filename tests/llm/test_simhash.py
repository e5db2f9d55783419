import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corrvox.llm import simhash as S


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    """Smallest identifier reachable, by comparing all pairs."""
    u = sorted(set(fps))
    a = np.array(u, np.uint64)
    label = list(range(len(u)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1:
            label[max(root(i), root(j))] = min(root(i), root(j))
    at = {x: root(i) for i, x in enumerate(u)}
    least = {}
    for x, d in zip(fps, ids, strict=True):
        if d is not None:
            least[at[x]] = min(d, least.get(at[x], d))
    return [least.get(at[x]) for x in fps]


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "a b\vc", "Größe ÄB x y Z", "　x y", " ".join(rng.choices(["Ab", "cd", "é", "日本"], k=3000))] + [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (3, 4, 5, 60, 999, 1004)]
    assert [S.fingerprint_of(t.encode()) for t in texts] == [print_of(t) for t in texts]


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 7)])
def test_links_reach_all_that_all_pairs_reach(spark, seed, block):
    rng = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):  # chains and stars of near ones, halves that are equal, and a dense group
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            x = near(rng, x, 4)
    hot = rng.getrandbits(64)
    fps |= {near(rng, hot, 5) for _ in range(120)} | {(hot & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(60)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(rows, "fp long")
    assert S.replicas(df).groupBy("fp").count().agg(F.max("count")).first()[0] <= 36
    links = S.fingerprint_links(df, block).collect()
    own = {r.a % (1 << 64) for r in links} | {r.b % (1 << 64) for r in links}
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
        label[max(a, b)] = min(a, b)
    order = sorted(fps)
    assert [root(x) for x in order] == components(order, order)
    assert own <= fps


def test_every_pair_of_halves_shares_an_anchor(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(400):
        x = rng.getrandbits(32)
        y = x
        for b in rng.sample(range(32), k % 3) if k % 4 else [31, rng.randrange(31)]:
            y ^= 1 << b
        pairs.append((k, x, y))
    df = spark.createDataFrame(pairs, "k long, x long, y long")
    keys = lambda c: S.replicas(df.select(F.col(c).alias("fp")).distinct()).where(F.col("anchor") < 1 << 32).withColumnRenamed("fp", c)
    assert df.join(keys("x"), "x").join(keys("y"), ["y", "anchor"]).select("k").distinct().count() == 400


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    docs = [(k, base[k % 12]) for k in range(60)]
    for k in range(60, 160):  # near copies with words replaced
        w = base[k % 12].split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "other"
        docs.append((k, " ".join(w)))
    docs += [(200, None), (201, ""), (None, " \n"), (None, base[0]), (5, base[3].upper()), (300, "x"), (301, "long " * 60_000), (302, base[11]), (302, base[11]), (None, "alone here")]
    got = S.near_duplicates(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, fp int, n int").repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [print_of(t) for _, t in docs]
    want = Counter(zip([d for d, _ in docs], [f"{x:016x}" for x in fps], components(fps, [d for d, _ in docs]), strict=True))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert max(Counter(c for _, _, c in want.elements()).values()) > 10


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
