"""Exact k nearest neighbours: blocks of space with a margin, searched in numpy, wider for the rows that need it.

Queries are dealt to cubes of ``BLOCK`` cells a side; targets go to every cube that their cell's width
reaches (1.5 cubes an axis on average). One shuffle brings a cube's queries and targets together; distances
are computed in chunks of bounded size, so memory is bounded by the targets of one cube. Of targets at one place only those
with the k + 1 smallest identifiers can be among the k nearest, so only they are compared: copies cost no square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrvox.operators.tables import cut

C = F.col
AXES = ("x", "y", "z")
BLOCK, CHUNK = 4, 2_000_000


def _places(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_numpy().astype(float) for a in AXES], 1)


def _distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    d2 = (q[:, None, 0] - t[None, :, 0]) ** 2
    for a in (1, 2):
        d2 += (q[:, None, a] - t[None, :, a]) ** 2
    return d2


def _first_copies(t: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Which rows are among the ``many`` smallest identifiers of their place, in the order of the rows."""
    bits = (t + 0.0).view(np.int64)  # one zero
    order = np.lexsort((ids, bits[:, 2], bits[:, 1], bits[:, 0]))
    new = np.ones(len(t), bool)
    new[1:] = (bits[order][1:] != bits[order][:-1]).any(1)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    return np.sort(order[np.arange(len(t)) - begin < many])


def _search(k: int, cell: float, with_self: bool, carry: tuple[str, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    side = BLOCK * cell
    fields = ("neighbour_id", "distance", *AXES, *carry)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, t = _places(left), _places(right)
        if len(t):
            few = _first_copies(t, right.column("neighbour_id").to_numpy(), k + 1)
            right, t = right.take(pa.array(few)), t[few]
        qid, tid = left.column("point_id").to_numpy(), right.column("neighbour_id").to_numpy()
        # Every target within this distance of a query is here: a cell's width beyond the walls of its cube.
        low = np.floor(q / side) * side
        sure = cell + np.maximum(0.0, np.minimum(q - low, low + side - q).min(1)) if len(q) else np.zeros(0)
        n, far = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, CHUNK // max(1, len(t)))
        for a in range(0, len(q), step) if len(t) else ():
            d2 = _distances(q[a : a + step], t)
            if not with_self:
                d2[qid[a : a + step, None] == tid[None]] = np.inf
            last = np.partition(d2, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
            row, col = np.nonzero((d2 <= last[:, None]) & (d2 < np.inf))
            value = d2[row, col]
            order = np.lexsort((tid[col], value, row))
            row, col, value = row[order], col[order], value[order]
            begin = np.searchsorted(row, np.arange(len(d2)))
            keep = np.arange(len(row)) - begin[row] < k
            row, col, value = row[keep], col[keep], value[keep]
            found.append((col, np.sqrt(value)))
            n[a : a + step] = np.bincount(row, minlength=len(d2))
            np.maximum.at(far, a + row, -np.inf)
            ends = np.cumsum(n[a : a + step])
            some = n[a : a + step] > 0
            far[a : a + step][some] = found[-1][1][ends[some] - 1]
        col = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
        distance = np.concatenate([d for _, d in found]) if found else np.zeros(0)
        taken = right.select(["neighbour_id", *AXES, *carry]).combine_chunks().take(pa.array(col))
        parts = {c: taken.column(c).combine_chunks() for c in ("neighbour_id", *AXES, *carry)} | {"distance": pa.array(distance)}
        near = pa.StructArray.from_arrays([_one(parts[f]) for f in fields], names=list(fields))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        whole = pa.array((n >= k) & (far <= sure))
        out = {c: left.column(c) for c in ("point_id", *AXES)} | {"whole": whole, "near": pa.ListArray.from_arrays(offsets, near)}
        return pa.table(out)

    return run


def _one(a: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) and a.num_chunks else (pa.array([], a.type) if isinstance(a, pa.ChunkedArray) else a)


def _near(queries: DataFrame, targets: DataFrame, k: int, cell: float, with_self: bool, carry: tuple[str, ...]) -> DataFrame:
    side, reach = BLOCK * cell, cell * (1 + 1e-9)
    keys = [f"b{a}" for a in AXES]
    q = queries.select(C("point_id").cast("long").alias("point_id"), *[C(a).cast("double").alias(a) for a in AXES], *[F.floor(C(a) / side).cast("long").alias(f"b{a}") for a in AXES])
    t = targets.select(C("point_id").cast("long").alias("neighbour_id"), *[C(a).cast("double").alias(a) for a in AXES], *carry)
    for a in AXES:
        t = t.withColumn(f"b{a}", F.explode(F.sequence(F.floor((C(a) - reach) / side).cast("long"), F.floor((C(a) + reach) / side).cast("long"))))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    fields = ", ".join([f"neighbour_id: bigint, distance: double, {', '.join(f'{a}: double' for a in AXES)}", *[f"{c}: {kinds[c]}" for c in carry]])
    schema = f"point_id long, x double, y double, z double, whole boolean, near array<struct<{fields}>>"
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(_search(k, cell, with_self, carry), schema)


def near_lists(queries: DataFrame, targets: DataFrame, k: int, cell: float, with_self: bool = False, carry: tuple[str, ...] = (), reach: float | None = None) -> DataFrame:
    """A row for each query: (point_id, x, y, z, near), ``near`` being its ``k`` nearest targets, nearest first, ties by id.

    An entry of ``near`` has neighbour_id, distance, x, y, z and the columns ``carry`` of the target. ``cell`` should
    hold the neighbours of most queries within one cell's width. Queries whose k-th neighbour lies farther than
    was searched go on with cells twice as wide, until none is left or the cells are wider than ``reach``
    (default: the extent of all points). Fewer than k targets give shorter lists.
    """
    if reach is None:
        both = queries.select(*AXES).unionByName(targets.select(*AXES))
        lo_hi = both.agg(*[F.max(a) - F.min(a) for a in AXES]).first()
        reach = max((v for v in lo_hi if v is not None), default=0.0)
    found = cut(_near(queries, targets, k, cell, with_self, carry))
    done: DataFrame | None = None
    while cell < reach:
        left = found.where("not whole").select("point_id", *AXES)
        if not left.limit(1).count():
            break
        ok = found.where("whole")
        done = ok if done is None else done.unionByName(ok)
        cell *= 2
        found = cut(_near(left, targets, k, cell, with_self, carry))
    return (found if done is None else done.unionByName(found)).drop("whole")


def knn(queries: DataFrame, targets: DataFrame, k: int, cell: float, with_self: bool = False, reach: float | None = None) -> DataFrame:
    """(point_id, neighbour_id, distance, rank) of the ``k`` nearest targets of each query (see ``near_lists``), rank from 1."""
    lists = near_lists(queries, targets, k, cell, with_self, reach=reach)
    return lists.select("point_id", F.posexplode("near").alias("place", "n")).select("point_id", "n.neighbour_id", "n.distance", (C("place") + 1).alias("rank"))


def median_spacing(points: DataFrame, cell: float) -> DataFrame:
    """One row: the median distance to the nearest other point."""
    return knn(points, points, 1, cell).agg(F.percentile("distance", F.lit(0.5)).alias("spacing"))


def inverse_distance(lists: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Means of the carried ``columns`` of each list of neighbours, weighted by 1 / distance squared; a neighbour at the point itself wins."""
    near = C("near")
    hit = F.filter(near, lambda n: n["distance"] < 1e-9)

    def weight(n):
        return 1 / F.pow(F.greatest(n["distance"], F.lit(1e-12)), 2)

    def weighted(c: str):
        return F.aggregate(near, F.lit(0.0), lambda s, n: s + weight(n) * n[c])

    total = F.aggregate(near, F.lit(0.0), lambda s, n: s + weight(n))
    means = [F.when(F.size(hit) > 0, F.get(hit, F.lit(0))[c]).otherwise(weighted(c) / total).alias(c) for c in columns]
    return lists.where(F.size("near") > 0).select("point_id", *means)
