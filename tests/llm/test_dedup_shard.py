import hashlib
import re
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash

from corrvox.llm.exact_dedup import exact_dedup
from corrvox.llm.sharding import shard_documents


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        out += [(d, first, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_groups_over_partitions(spark, parts):
    rows = [(k, "hot  text") for k in range(100)] + [(k, f"t{k % 30}\n\nx") for k in range(100, 200)] + [(500, None), (501, ""), (502, " "), (503, "a\x0b\x0cb"), (504, "a b"), (5, "hot text")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), parts=parts).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_dedup_edges(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = exact_dedup(spark.createDataFrame([(None, "x", 1), (3, "x", 2)], "doc_id long, text string, size int")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(3, 3, 2, True), (None, 3, 2, False)}


def test_shards(spark):
    rows = [(k, f"text é {k}" if k % 7 else None) for k in range(-50, 1500)] + [(3, "again"), (None, "x")]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    moved = sum(r.grown_shard == 16 for r in got)
    assert 0.5 < moved * 17 / len(got) < 1.5
    text = dict(rows)
    for r in got:
        if r.doc_id not in (3, None):
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    few = {r.doc_id: r.shard for r in shard_documents(spark.createDataFrame(rows[:9], "doc_id long, text string"), 16).collect()}
    assert all(few[r.doc_id] == r.shard for r in got if r.doc_id in few)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    assert {r.shard for r in shard_documents(spark.createDataFrame(rows[:9], "doc_id long, text string"), 1).collect()} == {0}


def jump(doc_id, shards):
    """The jump recurrence for one identifier."""
    b, j, step = -1, 0, 0
    while j < shards:
        b, step = j, step + 1
        draw = xxhash.xxh64(struct.pack("<i", step), xxhash.xxh64(struct.pack("<q", doc_id), 42).intdigest()).intdigest() >> 33
        j = int((b + 1) * ((1 << 31) / (draw + 1)))
    return b


def test_shards_as_one_by_one(spark):
    ids = [0, 1, -7, 2**40, *range(100, 400)]
    got = shard_documents(spark.createDataFrame([(k, "t") for k in ids], "doc_id long, text string"), 16).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {k: (jump(k, 16), jump(k, 17)) for k in ids}


def test_rows_of_one_identifier_are_dealt(spark):
    rows = [(None, f"t{k}", 1) for k in range(300)] + [(7, f"u{k}", 2) for k in range(300)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 16, buckets=8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 600 and all(sorted(s) == list(range(len(s))) for s in by.values())
