r"""A Merkle manifest of a dataset: digests of all rows, folded into one root, with a proof for each row.

H is the lowercase hex sha256 of its inputs, concatenated, digests as hex text. A leaf is H of the row's fields, each ``-``
if null, else its UTF-8 byte count, ``:`` and its value. Within a group (``source``) leaves ascend by identifier; every 16
consecutive nodes become their H, the last run even if it is one node, until one node is left: the group's subroot (a lone
leaf is its own). The subroots, ordered by group, fold to the root in the same way.

**Bottom-up build.** Each level is written as a table of parents with their children (``fanout`` at most). **Top-down proof
push.** From the root down, each level's parents join the proof suffix that their own parent inherited, and every child
prepends its siblings. The last join is with the parents of the leaves, a sixteenth of the rows, so no leaf's proof is
ever written or shuffled: it is made, hashed and folded where the leaf lies.

A row is verified against the root by folding its leaf, as recomputed from the row that is to be checked, with the stored siblings.

Rows that repeat an identifier are ordered by their leaf, then by where they were read; null identifiers come first. A null
group is a group. Null text, empty and very long texts are plain fields. An empty table has an empty manifest. Columns that
are not among the fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrvox.llm.common import join_small, materialize
from corrvox.llm.ordering import numbered

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_of(fields: list[Column]) -> Column:
    parts = []
    for f in fields:
        v = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return digest(F.concat(*parts))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of ``nodes`` (grp, pos, width, child struct with ``node``): at most ``fanout`` children meet in a group."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda x: x["child"])
    up = nodes.groupBy("grp", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(F.first("width").alias("width"), kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: k["node"]), "")
    # A group of one node is done: the node goes up as it is.
    return up.withColumn("node", F.when(F.col("width") == 1, F.element_at("kids", 1)["node"]).otherwise(digest(joined)))


def build_levels(leaves: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Written levels, the leaves' parents first; ``most`` is the width of the widest group.

    Each has grp, pos, width (nodes of the group among the children of this level), kids, node.
    """
    levels = [materialize(_parents(leaves, fanout), "level")]
    width = -(-most // fanout)
    while width > 1:
        above = levels[-1].select("grp", "pos", F.ceil(F.col("width") / fanout).cast("long").alias("width"), F.struct("node").alias("child")).where("width > 1")
        levels.append(materialize(_parents(above, fanout), "level"))
        width = -(-width // fanout)
    return levels


def _tops(levels: list[DataFrame], fanout: int) -> list[DataFrame]:
    """For each level its groups that end there."""
    return [x.where(F.col("width") <= fanout) for x in levels]


def _children(parents: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """One row for each child of ``parents`` that have their ``path``: the child's siblings come before what was inherited."""
    hexes = F.transform("kids", lambda k: k["node"])
    size = F.size("kids")
    at = F.col("at")
    step = F.struct(F.array_join(F.slice("hexes", 1, at), "").alias("before"), F.array_join(F.slice("hexes", at + 2, F.greatest(F.col("n") - at - 1, F.lit(0))), "").alias("after"))
    rows = parents.withColumns({"hexes": hexes, "n": size}).select("grp", "pos", "width", "path", "hexes", "n", *carried, F.posexplode("kids").alias("at", "kid"))
    path = F.when(F.col("width") == 1, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
    return rows.select("grp", (F.col("pos") * fanout + at).alias("pos"), path.alias("path"), "kid", *carried)


def push_down(levels: list[DataFrame], start: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """Children of the first level with their paths; ``start``: (grp, path, carried...) of each group's top."""
    down = None
    for level, top in zip(reversed(levels), reversed(_tops(levels, fanout)), strict=True):
        with_path = join_small(top, start, "grp")
        if down is not None:
            inner = level.where(F.col("width") > fanout)
            with_path = with_path.unionByName(inner.join(down.drop("kid"), ["grp", "pos"]))
        down = _children(with_path, fanout, *carried)
    return down


def fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def manifest(docs: DataFrame, checked: dict[str, Column] | None = None, when: Column | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``checked`` replaces fields by what is held against the manifest, where ``when`` is true (all rows if not given).
    """
    own = leaf_of([F.col(f) for f in fields])
    other = leaf_of([(checked or {}).get(f, F.col(f)) for f in fields])
    if not checked:
        other = F.lit(None).cast("string")
    elif when is not None:
        other = F.when(when, other)
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("source"), own.alias("leaf"), other.alias("seen"), F.monotonically_increasing_id().alias("read_at"))
    leaves = materialize(leaves, "leaves")  # texts are hashed once, the sampling of splitters reads digests

    placed, sizes = numbered(leaves, ["source"], ["doc_id", "leaf", "read_at"])
    groups, _ = numbered(sizes, [], ["source"], "grp")
    groups = materialize(groups, "groups")
    facts = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()

    of = groups.select(F.col("source").alias("_source"), "grp", F.col("size").alias("width"))
    nodes = join_small(placed, of, F.col("source").eqNullSafe(F.col("_source"))).select("grp", "pos", "width", F.struct("doc_id", "seen", F.col("leaf").alias("node")).alias("child"))
    levels = build_levels(nodes, facts["most"] or 0, fanout)

    subroots = None
    for top in _tops(levels, fanout):
        found = top.select("grp", "node")
        subroots = found if subroots is None else subroots.unionByName(found)
    upper = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(facts["n"]).cast("long").alias("width"), F.struct("node").alias("child"))
    upper_levels = build_levels(upper, facts["n"], fanout)
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    start = upper_levels[-1].select("grp", no_path.alias("path"), F.col("node").alias("root"))
    tops = push_down(upper_levels, start, fanout, "root").select(F.col("pos").alias("grp"), "path", F.col("kid.node").alias("subroot"), "root")

    rows = push_down(levels, materialize(tops, "tops"), fanout, "subroot", "root")
    proof = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))), "")
    out = rows.select("kid.doc_id", F.col("kid.node").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"), fold(F.coalesce("kid.seen", "kid.node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` held against rows whose A-Z in ``text`` are lower-cased where 5 divides crc32 of the decimal doc_id."""
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return manifest(docs, {"text": F.translate("text", UPPER, LOWER)}, hit)


# Levels by recursion; lists of siblings by level; folding by recursion over levels.
ORACLE_SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width,
    sha256(concat({own})) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256(concat({other})) ELSE sha256(concat({own})) END AS seen
  FROM documents),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT g, pos, width, leaf, seen, doc_id FROM leaves JOIN groups ON leaves.source IS NOT DISTINCT FROM groups.source),
tree AS (SELECT g, 0 AS lev, pos, width, leaf AS node FROM l
  UNION ALL SELECT g, lev + 1, pos // 16, (width + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE width > 1 GROUP BY g, lev, pos // 16, width),
sub AS (SELECT g, node AS subroot FROM tree WHERE width = 1),
upper AS (SELECT 0 AS lev, g AS pos, (SELECT count(*) FROM groups) AS width, subroot AS node FROM sub
  UNION ALL SELECT lev + 1, pos // 16, (width + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE width > 1 GROUP BY lev, pos // 16, width),
root AS (SELECT node AS root FROM upper WHERE width = 1),
runs AS (SELECT g, lev, pos // 16 AS run, list(node ORDER BY pos) AS kids FROM tree WHERE width > 1 GROUP BY g, lev, pos // 16),
uruns AS (SELECT lev, pos // 16 AS run, list(node ORDER BY pos) AS kids FROM upper WHERE width > 1 GROUP BY lev, pos // 16),
steps AS (
  SELECT l.g, l.pos, r.lev AS lev, array_to_string(kids[1:(l.pos // (16 ** r.lev)::BIGINT) % 16], '') AS b, array_to_string(kids[(l.pos // (16 ** r.lev)::BIGINT) % 16 + 2:], '') AS a
  FROM l JOIN runs r ON r.g = l.g AND r.run = l.pos // (16 ** (r.lev + 1))::BIGINT
  UNION ALL
  SELECT l.g, l.pos, 100 + r.lev, array_to_string(kids[1:(l.g // (16 ** r.lev)::BIGINT) % 16], ''), array_to_string(kids[(l.g // (16 ** r.lev)::BIGINT) % 16 + 2:], '')
  FROM l JOIN uruns r ON r.run = l.g // (16 ** (r.lev + 1))::BIGINT),
paths AS (SELECT g, pos, list({{'b': b, 'a': a}} ORDER BY lev) AS path FROM steps GROUP BY g, pos),
fold AS (SELECT l.g, l.pos, 0 AS k, l.seen AS h, p.path FROM l LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos
  UNION ALL SELECT g, pos, k + 1, sha256(concat(path[k + 1].b, h, path[k + 1].a)), path FROM fold WHERE k < len(path)),
ends AS (SELECT g, pos, h FROM fold WHERE k = coalesce(len(path), 0))
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(list_transform(p.path, lambda q: concat(q.b, q.a)), ''), '')) AS proof_sha256,
  e.h AS folded_root, e.h = r.root AS verified
FROM l JOIN sub s ON s.g = l.g CROSS JOIN root r JOIN ends e ON e.g = l.g AND e.pos = l.pos LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos"""


def oracle_sql() -> str:
    def parts(text: str) -> str:
        return ", ".join(f"coalesce(concat(octet_length(encode({v}::VARCHAR))::VARCHAR, ':', {v}::VARCHAR), '-')" for v in [*FIELDS[:-1], text])

    # crc32 is no function of DuckDB: the table of the polynomial is folded over the digits.
    return ORACLE_SQL.format(own=parts("text"), other=parts(f"translate(text, '{UPPER}', '{LOWER}')"), crc=_CRC)


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: list_reduce(list_prepend(xor(c, d), range(0, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
