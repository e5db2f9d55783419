"""What grows with the tables: work per copy, rows of one task, plans."""

import numpy as np
from pyspark.sql import functions as F

from corrvox.functions import kernels
from corrvox.functions.kernels import Search, Volume, cube_offsets
from corrvox.operators import tiling


def test_copies_of_a_point_are_solved_once(monkeypatch):
    rng = np.random.default_rng(2)
    w = rng.uniform(0.1, 0.4, (6, 3))
    z, y, x = np.meshgrid(*[np.arange(24.0)] * 3, indexing="ij")
    image = lambda s: Volume(100 + 10 * np.cos((np.stack([x, y, z], -1) - s) @ w.T).sum(-1))
    centres = np.array([[11.0, 12, 12], [12, 12, 12], [12, 11, 12]])[np.arange(60) % 3]
    seeds = np.where(np.arange(60)[:, None] < 30, 0.0, 0.25) * np.ones(3)
    seen, real = [], kernels.Batch
    monkeypatch.setattr(kernels, "Batch", lambda a, b, c, *rest: seen.append(len(c)) or real(a, b, c, *rest))
    search, o = Search(disp_max=2.0), cube_offsets(125, 8.0)
    r = kernels.solve(image(0.0), image(0.5), centres, seeds, o, search)
    assert sum(seen) == 6 and (r["status"] == 0).all() and r["params"].shape == (60, 3)
    for i in range(60):
        one = kernels.solve(image(0.0), image(0.5), centres[i : i + 1], seeds[i : i + 1], o, search)
        assert all((one[k][0] == r[k][i]).all() for k in one)


def test_a_full_tile_is_dealt_over_parts(spark):
    p = spark.range(4000).selectExpr("id AS point_id", "CAST(id % 5 AS double) AS x", "0D AS y", "0D AS z").unionByName(spark.sql("SELECT 9000L AS point_id, 90D AS x, 0D AS y, 0D AS z"))
    dealt = tiling.parted(tiling.tile_of(p, 64.0), ["tx", "ty", "tz"], most=100, copies=200)
    sizes = {(r.tx, r.part): r["count"] for r in dealt.groupBy("tx", "part").count().collect()}
    assert sum(sizes.values()) == 4001 and sizes[1, 0] == 1
    assert len(sizes) > 20 and max(sizes.values()) < 400
    piles = dealt.where("tx = 0").groupBy("x").agg(F.countDistinct("part").alias("n")).collect()
    assert all(r.n <= 20 for r in piles)  # copies meet: 40 parts, 20 piles


def test_speckle_bricks_meet_by_a_shuffle(spark, monkeypatch):
    from corrvox.plans import queries_cases

    plans, real = [], queries_cases.cut
    monkeypatch.setattr(queries_cases, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    r = queries_cases.speckle(spark, "/root/testdata/sf0.001").collect()
    assert len(r) == 1 and r[0].same_by_brick and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def above_generate(df):
    """The plan's operators over the generator that makes many rows of one."""
    return df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0].lower()


def test_a_lattice_is_turned_by_a_matrix_made_once(spark):
    from corrvox.plans import queries_points

    df = queries_points.grid_in_mask(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert "cos(" in plan and "cos(" not in above_generate(df) and "exchange hashpartitioning" in plan


def test_templates_round_places_once_for_a_row(spark):
    from corrvox.plans import queries_geometry as q

    for df in (q.cube_template_query(spark, "/root/testdata/sf0.001"), q.grid_offsets(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "round(" in plan and "round(" not in above_generate(df) and "exchange hashpartitioning" in plan


def test_results_come_from_one_scan_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from corrvox.plans import fixtures

    old = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    twice = old.where("event_id < 3").selectExpr("* EXCEPT (value)", "value + 1 AS value").select(*old.columns)
    none = old.limit(1).selectExpr("CAST(NULL AS BIGINT) AS event_id", "* EXCEPT (event_id)").select(*old.columns)
    old.unionByName(twice).unionByName(none).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    a = fixtures.res_a(spark, str(tmp_path))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and a.rdd.getNumPartitions() == -(-(old.count() + 4) // 100)
    n = {r.point_id: r["count"] for r in a.groupBy("point_id").count().collect()}
    assert len(n) == old.count() and [n[i] for i in range(5)] == [4, 4, 4, 1, 1]  # as the SQL's join has it


def test_knn_compares_no_more_copies_than_can_be_near(spark, monkeypatch):
    from corrvox.operators import knn

    p = np.array([[5.0, 5, 5], [6, 5, 5], [5, -0.0, 5], [5, 0.0, 5]])[np.arange(400) % 4]
    ids = np.arange(400) * 7 % 400
    import pyarrow as pa

    table = lambda name: pa.table({name: ids, **{a: p[:, i] for i, a in enumerate("xyz")}})
    seen, real = [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda q, t: seen.append(len(t)) or real(q, t))
    out = knn._search(6, 8.0, False, ())(table("point_id"), table("neighbour_id")).to_pydict()
    assert max(seen) == 3 * 7
    for i in (0, 1, 2, 3, 399):
        d = ((p - p[i]) ** 2).sum(1)
        want = [b for _, b in sorted((d[j], ids[j]) for j in range(400) if j != i)[:6]]
        assert [n["neighbour_id"] for n in out["near"][i]] == want


def test_mask_steps_hold_few_bricks_at_a_time():
    import pandas as pd

    from corrvox.operators import masks

    class Rows:
        def mapInPandas(self, f, schema):
            return f

    one = np.ones((2, 2, 2), "u1")
    batch = pd.DataFrame([(k, 0, 0, 2, 2, 2, "|u1", one.tobytes()) for k in range(300)], columns=masks.COLUMNS)
    for step in (masks.each_brick(Rows(), lambda a: a), masks.label_bricks(Rows(), (600, 2, 2), 2)):
        sizes = [len(frame) for frame in step(iter([batch]))]
        assert sum(sizes) == 300 and max(sizes) <= 64
