import hashlib
import zlib

import pytest

from corrvox.llm.merkle import manifest, tampered_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """Root, and the siblings of each node from the leaves up as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[k].append((run[: p % fanout], run[p % fanout + 1 :]))
            at[k] = p // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]], fanout) for s in sources}
    root, up = tree([trees[s][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for r, path in zip(own[s], trees[s][1], strict=True):
            path = path + up[k]
            t = r[4]
            if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            seen = leaf((*r[:4], t))
            for before, after in path:
                seen = h(*before, seen, *after)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[x for b, a in path for x in b + a]), seen, seen == root))
    return sorted(out, key=str)


def rows_of(n, sources):
    texts = ["Plain text", "", None, "lower only", "Größe ÄÖ Upper", "A" * 70_000]
    return [(k * 3, sources[k % len(sources)], None if k % 7 == 0 else "de", None if k % 5 == 0 else k, texts[k % 6]) for k in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (1, [None]), (40, ["a"]), (17, ["a", "a", None]), (300, ["s", "s", "s", "ä", None, "", "Z"]), (60, [f"s{k}" for k in range(20)])])
def test_against_brute_force(spark, n, sources):
    rows = rows_of(n, sources)
    got = tampered_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_repeats_null_identifiers_and_extra_columns(spark):
    rows = rows_of(30, ["a", None])
    rows += rows[:5] + [(None, "a", None, None, "X"), (None, "a", None, None, "X"), (0, "a", None, None, "other")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", pos int, node string, grp int")
    assert sorted((tuple(r) for r in tampered_manifest(df).collect()), key=str) == brute(rows)


def test_deep_trees_with_a_small_fanout(spark):
    rows = rows_of(45, ["a", "b", "a"])
    got = manifest(spark.createDataFrame(rows, SCHEMA), fanout=2).collect()
    assert all(r.verified for r in got)
    assert {(r.doc_id, r.root, r.proof_sha256) for r in got} == {(r[0], r[3], r[4]) for r in brute(rows, 2)}


def test_empty_table(spark):
    assert tampered_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
