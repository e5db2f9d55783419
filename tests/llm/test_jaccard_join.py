import random
import re

import numpy as np
import pytest

from corrvox.llm.jaccard_join import Trie, jaccard_components, prefix_size


def shingles(text):
    t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows, schema="doc_id long, text string"):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect())


def near_copies(seed, groups=12, copies=6, words=(6, 70), edits=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(25))
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = rng.choice(vocab)
                else:
                    w.insert(at, rng.choice(vocab))
            t = " ".join(w)
            if rng.random() < 0.4:
                t += "\n" + passage
            rows.append((n, t.upper() if rng.random() < 0.1 else t))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = near_copies(seed, groups=25, copies=9, edits=3)
    assert got(spark, rows) == brute(rows)


def test_blocks_and_hot_shingles(spark, monkeypatch):
    import corrvox.llm.jaccard_join as j

    monkeypatch.setattr(j, "BLOCK", 3)
    monkeypatch.setattr(j, "FEW", 2)
    monkeypatch.setattr(j, "PIVOTS", ())
    rows = near_copies(5, groups=3, copies=30, words=(30, 40), edits=3)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "a b"), (9, "A  b"), (10, "a b c d e"), (11, "a b c d e"), (11, "a b c d e"), (12, "one")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    clash = jaccard_components(spark.createDataFrame([(1, "x y", 3, "k")], "doc_id long, text string, n int, component string"))
    assert [tuple(r) for r in clash.collect()] == [(1, 1, 1)]
    nulls = jaccard_components(spark.createDataFrame([(None, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert {tuple(r) for r in nulls} == {(None, 1, None), (2, 1, 2)}


def test_trie_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(rng.integers(0, 200, 30)).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 200, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(12)]
        probe = sets.pop()
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))}
        assert set(Trie(sets).linked(probe)) == want


def test_trie_of_beginnings_drops_no_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = np.unique(rng.integers(0, 300, 40)).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 300, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(10)]
        cut = [(s[int(lone) :][: prefix_size(len(s))], len(s), int(lone)) for s in sets for lone in [0]]
        trie = Trie([c[0] for c in cut[1:]], [c[1] for c in cut[1:]], [c[2] for c in cut[1:]])
        want = {i for i, s in enumerate(sets[1:]) if 100 * len(np.intersect1d(s, sets[0])) >= 80 * len(np.union1d(s, sets[0]))}
        assert want <= set(trie.linked(*cut[0]))


def test_prefix_size():
    assert [prefix_size(n) for n in (1, 4, 5, 6, 10)] == [1, 1, 2, 2, 3]


def test_all_pairs_are_looked_at_when_no_pivot_fits(spark):
    """The pivot of the shared shingles is too long for either of the two texts that link."""
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    shared, tail = words("s", 60), words("t", 60)
    rows = [(1, shared + tail), (2, shared + words("b", 3)), (3, shared + words("c", 3))]
    rows += [(4 + k, words(f"x{k}_", 300) + tail) for k in range(3)]
    rows = [(d, " ".join(w)) for d, w in rows]
    assert got(spark, rows) == brute(rows)


def test_keys_of_many_buckets():
    """Numbers of posted shingles stay distinct beyond 256 buckets."""
    import corrvox.llm.jaccard_join as j

    assert j.CLASSES << j._KEY_BITS == 1 << 64
    key = [(599 << 32) | 7, (599 - 512 << 32) | 7, (599 - 256 << 32) | 7]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"rep": 1, "tokens": [{"class": 255, "key": k} for k in key]}])
    seq = np.frombuffer(next(j._sequence(iter([batch]))).column("seq")[0].as_py(), np.uint64)
    assert len(set(seq.tolist())) == 3 and sorted(key) == (seq & np.uint64(j._MASK)).tolist()
