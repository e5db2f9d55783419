"""Digests of tables and files that do not depend on partitions, made without ordering anything as a whole.

A table's digest is a tree over ranges of its key: rows of ``LEAF`` neighbouring keys are hashed together in order of the key,
then ``FANOUT`` neighbouring ranges, until one is left. A file's digest is the hash of the hashes of its blocks. So one
changed row or byte changes the digest, and two digests' levels tell where tables differ.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.sources import files

C = F.col
LEAF, FANOUT, BLOCK = 1024, 64, 16 << 20


def row_digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest): sha256 of the columns as JSON, so that null, text and numbers can't be taken for each other."""
    return rows.select(C(key).cast("long").alias("key"), F.sha2(F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"}), 256).alias("digest"))


def _up(nodes: DataFrame, size: int) -> DataFrame:
    """Hashes of neighbouring nodes; ranges without rows have no node."""
    held = F.array_sort(F.collect_list(F.struct("key", "digest")))
    text = F.array_join(F.transform(held, lambda n: F.concat(n["key"].cast("string"), F.lit(":"), n["digest"])), ";")
    return nodes.groupBy(F.floor(C("key") / size).cast("long").alias("key")).agg(F.sha2(text, 256).alias("digest"))


def table_levels(rows: DataFrame, key: str, columns: list[str]) -> list[DataFrame]:
    """The levels of the tree, (key, digest) each, the last of one row. Keys must be unique, not null and not negative: then no range holds
    more than ``LEAF`` rows."""
    ends = rows.agg(F.coalesce(F.min(key), F.lit(0)).alias("lo"), F.coalesce(F.max(key), F.lit(0)).alias("hi")).first()
    if ends["lo"] < 0:
        raise ValueError(f"{key} must not be negative")
    levels, lo, hi = [_up(row_digests(rows, key, columns), LEAF)], ends["lo"] // LEAF, ends["hi"] // LEAF
    while lo != hi:
        levels.append(_up(levels[-1], FANOUT))
        lo, hi = lo // FANOUT, hi // FANOUT
    return levels


def table_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row, ``digest``; no row for an empty table."""
    return table_levels(rows, key, columns)[-1].select("digest")


def differing_ranges(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(lo, hi): ranges of keys, both ends included, whose rows are not the same in both tables."""
    one, two = (_up(row_digests(t, key, columns), LEAF).withColumnRenamed("digest", n) for t, n in ((a, "one"), (b, "two")))
    both = one.join(two, "key", "full_outer").where(~C("one").eqNullSafe(C("two")))
    return both.select((C("key") * LEAF).alias("lo"), (C("key") * LEAF + LEAF - 1).alias("hi"))


def file_digest(spark: SparkSession, path: str, block: int = BLOCK) -> str:
    """sha256 over the hex sha256 of the file's blocks in order; a task reads a block at a time."""
    n = -(-files.size(path) // block)

    def run(batches):
        for b in batches:
            rows = []
            fs, p = files.place(path)
            with fs.open_input_file(p) as f:
                for k in b["id"]:
                    rows.append((int(k), hashlib.sha256(f.read_at(block, int(k) * block)).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "digest"])

    found = spark.range(0, n, 1, max(1, min(n, 1024))).mapInPandas(run, "id long, digest string").orderBy("id").toLocalIterator()
    whole = hashlib.sha256()
    for r in found:  # a digest for each block
        whole.update(r["digest"].encode())
    return whole.hexdigest()
