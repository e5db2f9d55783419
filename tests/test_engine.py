import dataclasses
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrvox import config
from corrvox.functions.kernels import Search, cube_offsets
from corrvox.operators import strain
from corrvox.operators.knn import knn
from corrvox.plans import correlate as c
from corrvox.plans import run
from corrvox.sources import text, volume_sink, volumes
from corrvox.streaming import timeline


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "point_id long, x double, y double, z double")


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0, 30, (60, 3)), [[200, 0, 0]], [[5, 5, 5]] * 3])
    got = {}
    for r in knn(cloud(spark, p), cloud(spark, p), 4, 5.0).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.neighbour_id))
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(1)
        want = sorted((d[j], j) for j in range(len(p)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert knn(cloud(spark, p[:3]), cloud(spark, p[:3]), 9, 5.0).count() == 6


def affine(spark, pts, g, extra=""):
    rows = [(i, *map(float, p), 0, 0.0, *map(float, np.array([0.1, 0.2, 0.3]) + np.array(g) @ p)) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, status int, objmin double, u double, v double, w double")


def test_strain(spark):
    g = np.array([[0.01, 0.02, 0], [0.004, -0.02, 0.006], [0, 0.002, 0.03]])
    pts = np.stack(np.meshgrid(*[np.arange(5) * 8.0] * 3), -1).reshape(-1, 3)
    for r in strain.strain(affine(spark, pts, g), 25, 16.0).collect():
        assert np.allclose(np.array(r.grad).reshape(3, 3), g, atol=1e-10)
        small = (g + g.T) / 2
        assert np.allclose([r.exx, r.eyz, r.exz], [small[0, 0], small[1, 2], small[0, 2]]) and np.allclose([r.ep1, r.ep2, r.ep3], np.linalg.eigvalsh(small)[::-1])
        assert r.l_exx == pytest.approx((small + g.T @ g / 2)[0, 0])
    two = strain.strain(affine(spark, pts[(pts[:, 2] < 12)], g), 25, 16.0).collect()
    assert all(np.isnan(r.exx) for r in two)  # two levels can't give a quadratic
    flat = strain.strain(affine(spark, pts[pts[:, 2] == 8], g), 9, 16.0).collect()
    assert all(r.ep3 == 0 and r.exz == 0 and abs(r.exx - 0.01) < 1e-9 for r in flat)


def test_tiles_give_what_the_whole_gives(spark):
    rng = np.random.default_rng(0)
    w = np.column_stack([rng.uniform(0.1, 0.5, (12, 3)), rng.uniform(0, 6, 12)])
    shape = (36, 36, 36)
    ref, moved = c.wave_bricks(spark, w, shape, 16), c.wave_bricks(spark, w, shape, 16, lambda p: p - 0.5)
    pts = c.rigid_seeds(cloud(spark, [(x, y, 18) for x in (14, 18, 22) for y in (14, 20)]))
    plan = {"shape": shape, "offsets": cube_offsets(216, 10.0), "search": Search(disp_max=2.0, dof=6), "brick": 16}
    a, b = ({r.point_id: r for r in c.correlate(pts, ref, moved, tile=t, **plan).collect()} for t in (64.0, 8.0))
    assert all(a[i] == b[i] and a[i].status == 0 and abs(a[i].u - 0.5) < 0.02 for i in a) and len(a) == 6


def npy(path, a):
    np.save(path, a)
    return str(path)


def test_volume_formats(spark, tmp_path):
    a = np.arange(10 * 9 * 11, dtype=np.uint16).reshape(10, 9, 11)
    want = {(r.x, r.y, r.z): r.v for r in _voxels(spark, npy(tmp_path / "a.npy", a))}
    assert want[(10, 8, 9)] == a[9, 8, 10] and len(want) == a.size
    a.astype(">u2").tofile(tmp_path / "a.raw")
    assert {(r.x, r.y, r.z): r.v for r in _voxels(spark, str(tmp_path / "a.raw"), shape="11,9,10", dtype=">u2")} == want
    (tmp_path / "a.mhd").write_text("NDims = 3\nDimSize = 11 9 10\nElementType = MET_USHORT\nBinaryDataByteOrderMSB = True\nElementDataFile = a.raw\n")
    assert {(r.x, r.y, r.z): r.v for r in _voxels(spark, str(tmp_path / "a.mhd"))} == want
    _zarr(tmp_path / "a.zarr", a)
    assert {(r.x, r.y, r.z): r.v for r in _voxels(spark, str(tmp_path / "a.zarr"))} == want
    with pytest.raises(Exception, match="too short"):
        volumes.layout(str(tmp_path / "a.raw"), {"shape": "12,9,10", "dtype": "u2"})
    for bad in ("ElementType = MET_LONG", "CompressedData = True", "ElementNumberOfChannels = 3", "ElementDataFile = LOCAL", "HeaderSize = -1", "DimSize = 1 x 3", "NDims = 2"):
        (tmp_path / "b.mhd").write_text("DimSize = 11 9 10\nElementType = MET_USHORT\nElementDataFile = a.raw\n" + bad + "\n")
        with pytest.raises(ValueError):
            volumes.mhd_layout(str(tmp_path / "b.mhd"))
    bricks = volumes.read_bricks(spark, str(tmp_path / "a.mhd"), 4)
    volume_sink.write_raw(bricks, (11, 9, 10), "<u2", 4, str(tmp_path / "out.raw"))
    assert (np.fromfile(tmp_path / "out.raw", "<u2").reshape(a.shape) == a).all()
    volumes.convert(bricks, str(tmp_path / "bricks"))
    assert spark.read.parquet(str(tmp_path / "bricks")).count() == 3 * 3 * 3
    assert {r.bz for r in volumes.read_bricks(spark, str(tmp_path / "a.mhd"), 4).where("bz = 1").select("bz").collect()} == {1}
    assert volume_sink.crc32c(b"123456789") == 0xE3069283  # the check value of the checksum's definition
    for name, brick, shard in (("s.zarr", 4, 2), ("t.zarr", 64, 8)):
        out, more = str(tmp_path / name), volumes.read_bricks(spark, str(tmp_path / "a.mhd"), brick)
        volume_sink.write_zarr(more, (11, 9, 10), ">u2", brick, out, shard)
        assert {(r.x, r.y, r.z): r.v for r in _voxels(spark, out)} == want and volumes.missing_chunks(spark, out) == 0
        with pytest.raises(FileExistsError):
            volume_sink.write_zarr(more, (11, 9, 10), ">u2", brick, out, shard)
    with pytest.raises(Exception, match="26 of 27 bricks"):
        volume_sink.write_zarr(bricks.where("bx + by + bz > 0"), (11, 9, 10), ">u2", 4, str(tmp_path / "u.zarr"), 2)
    assert not list(tmp_path.glob("u.zarr*"))
    volume_sink.write_zarr(bricks, (11, 9, 10), "<u2", 4, str(tmp_path / "s.zarr"), 3, overwrite=True)
    with pytest.raises(FileExistsError, match="not a zarr"):
        volume_sink.write_zarr(bricks, (11, 9, 10), "<u2", 4, str(tmp_path / "bricks"), overwrite=True)
    os.rename(tmp_path / "t.zarr" / "0" / "c" / "0" / "0" / "0", tmp_path / "moved")
    with pytest.warns(UserWarning, match="1 of 1 chunks"):
        assert volumes.missing_chunks(spark, str(tmp_path / "t.zarr")) == 1


def test_a_box_opens_only_its_bricks(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, Not, StringContains

    a = np.arange(20 * 18 * 22, dtype=np.uint16).reshape(20, 18, 22)
    path = npy(tmp_path / "a.npy", a)
    reader = volumes.VolumeReader({"path": path, "brick": "4", "task_mb": "0.0001"})
    left = list(reader.pushFilters([IsNotNull(("bx",)), GreaterThanOrEqual(("bx",), 1), LessThan(("bx",), 3), In(("by",), (0, 2, 9)), EqualTo(("bz",), 4), Not(EqualTo(("bx",), 1)), StringContains(("dtype",), "u")]))
    assert [type(f).__name__ for f in left] == ["Not", "StringContains"]
    opened = [r for p in reader.partitions() for r in p.rows]
    assert opened == [(4, 0, [1, 2]), (4, 2, [1, 2])] and len(reader.partitions()) == 2
    assert len([r for p in volumes.VolumeReader({"path": path, "brick": "4"}).partitions() for r in p.rows]) == 25
    volumes.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW vol USING volume OPTIONS (path '{path}', brick '4')")
    box = spark.sql("SELECT * FROM vol WHERE bx BETWEEN 1 AND 2 AND by IN (0, 2) AND bz = 4")
    assert " Filter " not in box._jdf.queryExecution().executedPlan().toString()
    assert {(r.bx, r.by, r.bz) for r in box.collect()} == {(x, y, 4) for x in (1, 2) for y in (0, 2)}
    lo, hi = (3, 5, 7), (19, 6, 17)
    got = volumes.voxel_rows(volumes.in_box(volumes.read_bricks(spark, path, 4), lo, hi, 4), 4, lo, hi).collect()
    assert {(r.x, r.y, r.z, r.v) for r in got} == {(x, y, z, float(a[z, y, x])) for x in range(3, 19) for y in (5,) for z in range(7, 17)}
    assert spark.sql("SELECT * FROM vol WHERE bx > 90").collect() == [] and spark.sql("SELECT * FROM vol WHERE bx = NULL").collect() == []
    f = np.asfortranarray(a)
    assert {(r.x, r.y, r.z): r.v for r in _voxels(spark, npy(tmp_path / "f.npy", f))} == {(r.x, r.y, r.z): r.v for r in _voxels(spark, path)}


def test_levels_are_block_means_and_failures_leave_nothing(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 999, (13, 9, 18)).astype(np.uint16)
    bricks = volumes.read_bricks(spark, npy(tmp_path / "a.npy", a), 4)
    out = str(tmp_path / "p.zarr")
    volume_sink.write_zarr(bricks, (18, 9, 13), "<u2", 4, out, 2, levels=3)
    for level in range(1, 3):
        wide = np.pad(a.astype(float), [(0, n % 2) for n in a.shape], constant_values=np.nan)
        a = np.rint(np.nanmean(wide.reshape(wide.shape[0] // 2, 2, wide.shape[1] // 2, 2, wide.shape[2] // 2, 2), axis=(1, 3, 5))).astype(np.uint16)
        got = _voxels(spark, out, level=str(level))
        assert {(r.x, r.y, r.z): r.v for r in got} == {(x, y, z): float(v) for (z, y, x), v in np.ndenumerate(a)}
    assert [len(x["datasets"]) for x in json.loads((tmp_path / "p.zarr" / "zarr.json").read_text())["attributes"]["ome"]["multiscales"]] == [3]

    def broken(batches):
        for b in batches:
            if (b["bz"] == 2).any():
                raise RuntimeError("lost")
            yield b

    for bad, why in ((bricks.mapInPandas(broken, bricks.schema), "lost"), (bricks.unionByName(bricks.where("bx = 0")), "comes twice")):
        with pytest.raises(Exception, match=why):
            volume_sink.write_array(bad, (18, 9, 13), "<u2", 4, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="voxels came"):
        volume_sink.write_raw(bricks.where("bx > 0"), (18, 9, 13), "<u2", 4, str(tmp_path / "bad"))
    assert not list(tmp_path.glob("bad*"))


def test_reach_holds_every_box(spark):
    from corrvox.operators import tiling

    rng = np.random.default_rng(5)
    for far in (3.0, 9.5):
        rows = [(i, *p, *s) for i, (p, s) in enumerate(zip(rng.uniform(0, 90, (40, 3)).tolist(), rng.normal(0, 8, (40, 3)).tolist(), strict=True))]
        pts = spark.createDataFrame(rows, "point_id long, x double, y double, z double, su double, sv double, sw double")
        lo, hi = c.reach_box(pts, far)
        boxes = tiling.plan(pts, 32.0, far, 1.0).collect()
        assert all(lo[i] <= b[f"{k}_{a}_lo"] and b[f"{k}_{a}_hi"] <= hi[i] for b in boxes for k in ("ref", "def") for i, a in enumerate("xyz"))


def _voxels(spark, path, **options):
    return volumes.voxel_rows(volumes.read_bricks(spark, path, 4, **options), 4).collect()


def _zarr(root, a):
    """A sharded zarr v3 array: shards of 8**3 in chunks of 4**3, zstd, an index at the end."""
    import zstandard

    os.makedirs(root)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [4, 4, 4], "codecs": codecs, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(a.shape), "data_type": a.dtype.name, "chunk_grid": {"configuration": {"chunk_shape": [8, 8, 8]}}, "codecs": [shard], "fill_value": 0}
    (root / "zarr.json").write_text(json.dumps(meta))
    wide = np.zeros((16, 16, 16), a.dtype)
    wide[: a.shape[0], : a.shape[1], : a.shape[2]] = a
    for s in np.ndindex(2, 2, 2):
        body, index = b"", []
        for k in np.ndindex(2, 2, 2):
            z, y, x = (8 * p + 4 * q for p, q in zip(s, k, strict=True))
            chunk = wide[z : z + 4, y : y + 4, x : x + 4]
            if not chunk.any():
                index += [(1 << 64) - 1] * 2
                continue
            raw = zstandard.compress(chunk.tobytes())
            index += [len(body), len(raw)]
            body += raw
        path = root / "c" / str(s[0]) / str(s[1])
        os.makedirs(path, exist_ok=True)
        (path / str(s[2])).write_bytes(body + struct.pack("<16Q", *index) + b"\0\0\0\0")


def test_run_and_resume(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    w = np.column_stack([rng.uniform(0.1, 0.5, (12, 3)), rng.uniform(0, 6, 12)])
    z, y, x = np.meshgrid(*[np.arange(36.0)] * 3, indexing="ij")
    p = np.stack([x, y, z], -1)
    (tmp_path / "p.roi").write_text("n x y z\n# points\n" + "".join(f"{i}\t{16 + i % 3 * 2}, 18 {16 + i // 3 * 2} # p\n" for i in range(6)))
    cfg = config.build(config.RunConfig, {
        "volumes": {"reference": npy(tmp_path / "r.npy", c.wave_values(w, p)), "deformed": npy(tmp_path / "d.npy", c.wave_values(w, p - 0.75))},
        "points": str(tmp_path / "p.roi"), "output": str(tmp_path / "out"), "subvolume": {"geometry": "cube", "size": 8, "n_samples": 216}, "search": {"dof": 3, "disp_max": 2.0},
        "seeding": {"strategy": "wavefront", "neighbours": 3}, "cluster": {"tile": 16, "brick": 16},
    })
    r = run.run(spark, cfg).collect()
    assert len(r) == 6 and all(q.status == 0 and abs(q.u - 0.75) < 0.02 for q in r)
    assert run.run(spark, cfg).count() == 6  # nothing is left to do
    run.finish(spark, cfg, 2.0)
    out = next(f for f in (tmp_path / "out" / "disp").iterdir() if f.name.startswith("part"))
    back = text.read_results(spark, str(out)).collect()
    assert sorted(q.point_id for q in back) == list(range(6)) and all(abs(q.w - 0.75) < 0.02 for q in back)
    assert run.compare(spark, str(tmp_path / "out" / "results"), str(out)).first()["p99"] < 1e-6
    assert not list((tmp_path / "out" / "work").iterdir())
    # A run that is stopped in a step goes on with the rest, and ends with the rows of one that wasn't stopped.
    whole = sorted((q.point_id, q.status, q.n_iter, q.seed_u, q.u, q.v, q.w) for q in r)
    for strategy, tile, least in (("wavefront", 16, 1), ("rigid", 2, 3)):
        again = dataclasses.replace(cfg, output=str(tmp_path / strategy), seeding=dataclasses.replace(cfg.seeding, strategy=strategy), cluster=config.Cluster(tile, 16))
        solve, calls = c.correlate, []

        def stops(*args, solve=solve, calls=calls, **plan):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("stopped")
            return solve(*args, **plan)

        monkeypatch.setattr(c, "correlate", stops)
        with pytest.raises(RuntimeError, match="stopped"):
            run.run(spark, again, step_points=1)
        monkeypatch.setattr(c, "correlate", solve)
        before = {q.point_id: q.u for q in spark.read.parquet(f"{again.output}/results").collect()}
        assert least <= len(before) < 6
        rows = run.run(spark, again, step_points=1).collect()
        assert len(rows) == 6 and before.items() <= {q.point_id: q.u for q in rows}.items()
        assert strategy == "rigid" or sorted((q.point_id, q.status, q.n_iter, q.seed_u, q.u, q.v, q.w) for q in rows) == whole
    few = dataclasses.replace(cfg, output=str(tmp_path / "coarse"), seeding=dataclasses.replace(cfg.seeding, strategy="coarse", coarse_stride=2))
    rows = run.run(spark, few).collect()
    assert sorted(q.point_id for q in rows) == list(range(6)) and all(q.status == 0 and abs(q.u - 0.75) < 0.02 for q in rows)
    assert 0 < spark.read.parquet(f"{few.output}/coarse").count() < 6
    dense = dataclasses.replace(cfg, output=str(tmp_path / "dense"), cluster=config.Cluster(16, 16, tile_points=2))
    rows = run.run(spark, dense).collect()
    assert sorted(q.point_id for q in rows) == list(range(6)) and all(abs(q.u - 0.75) < 0.02 for q in rows)
    # A volume of 36**3 in doubles, twice, takes 0.7 MB; boxes reach over its faces.
    with pytest.raises(ValueError, match="cluster.task_mb is 1: make cluster.tile"):
        run.run(spark, dataclasses.replace(cfg, output=str(tmp_path / "big"), search=dataclasses.replace(cfg.search, disp_max=40.0), cluster=config.Cluster(64, 16, task_mb=1)))
    other = config.build(config.RunConfig, {"volumes": {"reference": str(tmp_path / "r.npy"), "deformed": str(tmp_path / "d.npy")}, "points": cfg.points, "output": cfg.output, "search": {"dof": 6}})
    with pytest.raises(ValueError, match="other settings.*search.dof"):
        run.run(spark, other)


def test_config_is_strict():
    for bad in ({"search": {"dof": 4}}, {"search": {"objective": "x"}}, {"serach": {}}, {"search": {"dof": "6"}}, {"search": {"max_iterations": 0}}, {"subvolume": {"aspect": [1, 2]}}, {"search": {"method": "icgn"}}, {"seeding": {"strategy": "fft"}}):
        with pytest.raises(ValueError):
            config.build(config.RunConfig, bad)
    assert config.build(config.RunConfig, {"search": {"max_iterations": 5.0}}).search.max_iterations == 5
    s = dict(line.split(None, 1) for line in """reference_filename a.raw
correlate_filename b.raw
point_cloud_filename p.roi
output_filename out
vol_bit_depth 16
vol_endian big
vol_hdr_lngth 0
vol_wide 10
vol_high 11
vol_tall 12
subvol_geom cube
subvol_size 20
subvol_npts 500.0
disp_max 8
num_srch_dof 12
obj_function zssd
interp_type tricubic
rigid_trans 1, 2 3""".splitlines())
    cfg = config.from_settings(s)
    assert cfg.volumes.raw_dtype == ">u2" and cfg.subvolume.n_samples == 500 and cfg.search.rigid_trans == (1, 2, 3)
    for k, v, what in (("vol_bit_depth", "12", "vol_bit_depth"), ("subvol_npts", "1.5", "subvol_npts"), ("rigid_trans", "1 2", "rigid_trans")):
        with pytest.raises(ValueError, match=what):
            config.from_settings(s | {k: v})
    with pytest.raises(ValueError, match="disp_max"):
        config.from_settings({k: v for k, v in s.items() if k != "disp_max"})


def test_point_files(spark, tmp_path):
    for body, what in (("1 2 3 4\n1 2 3 5\n", "repeated"), ("", "no points"), ("1 2 3 4\nx\n", "cannot read"), ("1 2 nan 4\n", "cannot read")):
        f = tmp_path / "p.roi"
        f.write_text(body)
        with pytest.raises(Exception, match=what):
            text.read_points(spark, str(f)).collect()
    assert text.settings_map(spark.createDataFrame([(1, "subvol_size 20 ### s"), (2, "nope 1"), (3, "subvol_size 30")], "line_no long, line string")).first().asDict() == {"settings": {"subvol_size": "30", "nope": "1"}, "unknown": ["nope"]}


def test_timeline_stream(spark, tmp_path):
    rows = [{"worker": k % 2, "ev": "solve" if k % 3 else "read", "tile": k, "t0": 100.0 + k, "t1": 100.5 + k, "points": 5, "bytes": 10} for k in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    want = sorted(map(tuple, timeline.rates(timeline.read_events(spark, str(tmp_path / "in"))).collect()))
    q = timeline.rates(timeline.read_events(spark, str(tmp_path / "in"), True)).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("rates").collect())) == want and sum(r[2] for r in want) == 5 * 8


def test_speckle_does_not_depend_on_bricks(spark):
    a = volumes.voxel_rows(c.speckle_bricks(spark, (12, 8, 8), 8, 2.0, 5), 8).collect()
    assert len(a) == 12 * 8 * 8 and np.std([r.v for r in a]) > 100 and a == volumes.voxel_rows(c.speckle_bricks(spark, (12, 8, 8), 8, 2.0, 5).repartition(1), 8).collect()


def test_tiles_of_bounded_cost(spark):
    from corrvox.operators import kdtree
    from corrvox.operators.tables import cut

    rng = np.random.default_rng(4)
    w = np.column_stack([rng.uniform(0.1, 0.5, (12, 3)), rng.uniform(0, 6, 12)])
    shape = (48, 48, 48)
    at = np.concatenate([rng.uniform(16, 32, (20, 3)), rng.uniform(20, 22, (60, 3)), np.full((30, 3), 25.0)])
    pts = c.rigid_seeds(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "point_id long, x double, y double, z double"), (0.5, 0.0, 0.0))
    dealt = kdtree.kd_tiles(pts, 12, 1.0, 16.0, cut)
    sizes = [r["count"] for r in dealt.groupBy("tx", "ty", "tz").count().collect()]
    assert sum(sizes) == 110 and max(sizes) <= 24 and dealt.select("point_id").distinct().count() == 110
    assert dealt.where("x = 25").select("ty").distinct().count() > 1
    ref, moved = c.wave_bricks(spark, w, shape, 16), c.wave_bricks(spark, w, shape, 16, lambda p: p - 0.5)
    plan = {"offsets": cube_offsets(216, 10.0), "search": Search(dof=3, disp_max=4.0), "brick": 16, "ref": ref, "deformed": moved, "shape": shape}
    fixed = {r.point_id: (r.status, r.u, r.v, r.w) for r in c.correlate(pts, tile=32.0, **plan).collect()}
    bound = {r.point_id: (r.status, r.u, r.v, r.w) for r in c.correlate(pts, tile=32.0, most=12, cut=cut, **plan).collect()}
    assert fixed.keys() == bound.keys() and all(fixed[k][0] == bound[k][0] and np.allclose(fixed[k][1:], bound[k][1:], atol=1e-9) for k in fixed)
    assert c.correlate(pts.limit(0), tile=32.0, most=12, cut=cut, **plan).collect() == []


def test_stored_cells_are_pruned_and_checked(spark, tmp_path):
    import glob

    from corrvox.sources import cells

    rng = np.random.default_rng(6)
    at = np.concatenate([rng.uniform(-200, 200, (3000, 3)), rng.uniform(10, 14, (1500, 3))])
    df = spark.createDataFrame([(i, *map(float, p), f"r{i}") for i, p in enumerate(at)], "point_id long, x double, y double, z double, note string")
    path = str(tmp_path / "cells")
    for half in (0, 1):
        cells.append(df.where(f"point_id % 2 = {half}"), path, 16.0, 12)
    lo, hi = (-50.5, -20.0, 3.0), (40.0, 16.0, 70.0)
    got = cells.read_box(spark, path, lo, hi)
    want = {i for i, p in enumerate(at) if all(a <= v < b for v, a, b in zip(p, lo, hi))}
    assert got.columns == ["point_id", "x", "y", "z", "note"] and {r.point_id for r in got.collect()} == want
    inside = "cx between -4 and 2 and cy between -2 and 0 and cz between 0 and 4"
    held = {r.file for r in cells.index(spark, path).where(inside).collect()}
    assert {f.split("/")[-1] for f in got.inputFiles()} == {f.split("/")[-1] for f in held} and len(held) < 20
    pushed = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(code" in pushed or "code" in pushed.split("PushedFilters")[1]
    assert cells.read_box(spark, path, (500.0,) * 3, (600.0,) * 3).collect() == []
    # The full cell is cut over files.
    assert cells.index(spark, path).where("cx = 0 and cy = 0 and cz = 0").select("file").distinct().count() > 2
    assert cells.read_all(spark, path).count() == len(at) and cells.problems(spark, path).collect() == []
    os.remove(sorted(glob.glob(f"{path}/rows/*/part-*"))[3])
    assert {r.problem for r in cells.problems(spark, path).collect()} == {"fragment is missing"}


def test_ranges_of_codes():
    from corrvox.sources import cells

    code = lambda p: sum((c >> b & 1) << (3 * b + j) for j, c in enumerate(p) for b in range(21))
    rng = np.random.default_rng(8)
    for most in (4, 64):
        for _ in range(20):
            lo = rng.integers(0, 40, 3)
            hi = lo + rng.integers(0, 12, 3)
            ranges = cells.code_ranges(tuple(map(int, lo)), tuple(map(int, hi)), most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
            own = [code((x, y, z)) for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1) for z in range(lo[2], hi[2] + 1)]
            assert all(any(a <= k <= b for a, b in ranges) for k in own)
    assert cells.code_ranges((8, 8, 8), (15, 15, 15)) == [(code((8, 8, 8)), code((15, 15, 15)))]


def test_quantiles_by_selection(spark):
    from corrvox.operators.quantiles import quantiles
    from corrvox.operators.tables import cut

    rng = np.random.default_rng(9)
    sets = {"a": rng.normal(size=700), "b": np.repeat([3.0, 5.0], [500, 1]), "c": np.concatenate([10.0 ** -np.arange(30.0), [1e300, -1e300]]), None: np.array([7.0]), "e": np.array([np.nan, np.inf])}
    rows = [(g, float(v)) for g, vs in sets.items() for v in vs] + [("a", None), ("f", None)]
    shares = {"lo": 0.0, "q": 0.25, "mid": 0.5, "most": 0.97, "hi": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, cut, few=16, width=8).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g, r in got.items():
        assert np.allclose([r[k] for k in shares], np.quantile(sets[g], list(shares.values())), rtol=1e-12, atol=0)
    assert quantiles(spark.createDataFrame([], "v double"), [], "v", {"m": 0.5}, cut).collect() == []


def test_a_wavefront_reads_each_row_once(spark, tmp_path, monkeypatch):
    """Seeds are those of a plain loop over all earlier results, and no shelf is read twice."""
    from corrvox.operators import seeding, tables
    from corrvox.operators.knn import knn
    from corrvox.operators.tables import cut

    rng = np.random.default_rng(3)
    pts = cut(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 30, (120, 3)))], "point_id long, x double, y double, z double"))
    read, get = [], tables.Shelves.get
    monkeypatch.setattr(tables.Shelves, "get", lambda self, *k: (read.append((self.path, k)), get(self, *k))[1])

    def solve(seeds, shell):
        """A displacement that depends on the seed; a seventh of the points fail."""
        return cut(seeds.selectExpr("point_id", "x", "y", "z", "CAST(if(point_id % 7 = 0, -1, 0) AS INT) AS status", "x / 10 + su / 2 AS u", "sv + 1 AS v", "sw AS w"))

    got = {r.point_id: (r.u, r.v, r.w) for r in c.wavefront(pts, (0.0, 0.0, 0.0), 6.0, 5, 12.0, cut, (0.5, 0.0, 2.0), solve, str(tmp_path / "w")).collect()}
    assert len(read) == len(set(read)) > 10
    near = {}
    for r in knn(pts, pts, 5, 12.0).collect():
        near.setdefault(r.point_id, []).append(r.neighbour_id)
    rows = sorted(seeding.wavefront_shells(pts, (0.0, 0.0, 0.0), 6.0).collect(), key=lambda r: r.shell)
    want = {}
    for s in sorted({r.shell for r in rows}):
        new = {}
        for r in (r for r in rows if r.shell == s):
            good = [want[n] for n in near.get(r.point_id, []) if n in want and n % 7]
            su, sv, sw = np.mean(good, 0) if good else (0.5, 0.0, 2.0)
            new[r.point_id] = (r.x / 10 + su / 2, sv + 1, sw)
        want |= new
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_the_crop_with_the_most_foreground(spark, tmp_path):
    from corrvox.operators import crop

    a = np.random.default_rng(12).integers(0, 200, (21, 18, 30)).astype(np.uint8)
    a[6:16, 4:14, 12:22] += 50
    bricks = volumes.read_bricks(spark, npy(tmp_path / "a.npy", a), 4)
    for size, stride in ((8, 2), (6, 1), (40, 4)):
        sub = a[::stride, ::stride, ::stride].astype(float)
        hist, edges = np.histogram(sub, bins=256)
        w, m = np.cumsum(hist), np.cumsum(hist * (np.arange(256) + 0.5))
        limit = edges[int(np.argmax(np.round((m[-1] * w - m * w[-1]) ** 2 / np.maximum(w * (w[-1] - w), 1), 3)))]
        k = [min(max(size // stride, 1), n) for n in sub.shape]
        sums = np.lib.stride_tricks.sliding_window_view(sub > limit, k).sum((3, 4, 5))
        z, y, x = (min(int(o) * stride, max(n - size, 0)) for o, n in zip(np.unravel_index(int(sums.argmax()), sums.shape), a.shape))
        r = crop.choose_crop(bricks, (30, 18, 21), 4, size, stride).first()
        assert (r.x, r.y, r.z, r.n) == (x, y, z, sums.max()) and abs(r.threshold - limit) < 1e-9


def _flood(mask):
    """Labels by flooding from each voxel in turn."""
    label, n = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask):
        if label[tuple(start)]:
            continue
        n += 1
        todo = [tuple(start)]
        while todo:
            p = todo.pop()
            if min(p) < 0 or any(k >= m for k, m in zip(p, mask.shape)) or not mask[p] or label[p]:
                continue
            label[p] = n
            todo += [tuple(k + (s if j == a else 0) for j, k in enumerate(p)) for a in range(3) for s in (-1, 1)]
    return label


def test_the_mask_of_a_specimen(spark, tmp_path):
    from corrvox.functions.kernels import gaussian
    from corrvox.operators import masks
    from corrvox.operators.tables import cut

    rng = np.random.default_rng(14)
    z, y, x = np.indices((22, 19, 26))
    a = (60 + 40 * rng.standard_normal(z.shape)).clip(0, 255)
    ball = (z - 11) ** 2 + (y - 9) ** 2 + (x - 11) ** 2
    a[ball < 80] += 120
    a[ball < 9] -= 120  # a hole
    a[1:6, 0:5, 21:26] += 120  # another part
    a = a.clip(0, 255).astype(np.uint8)
    bricks, shape = volumes.read_bricks(spark, npy(tmp_path / "a.npy", a), 8), (26, 19, 22)
    got = masks.sample_mask(bricks, shape, 8, cut, sigma=1.0, times=1)
    reach = 4
    smooth = gaussian(np.pad(a.astype(float), reach, mode="symmetric"), 1.0)[reach:-reach, reach:-reach, reach:-reach]
    solid = smooth > 0.5 * (np.quantile(smooth, 0.05) + np.quantile(smooth, 0.75))

    def step(m, grow):
        p = np.pad(m, 1)
        moved = [np.roll(p, s, axis)[1:-1, 1:-1, 1:-1] for axis in range(3) for s in (-1, 1)]
        return np.logical_or.reduce([m, *moved]) if grow else np.logical_and.reduce([m, *moved])

    solid = step(step(solid, False), True)
    label = _flood(solid)
    solid = label == 1 + np.argmax(np.bincount(label.ravel())[1:])
    holes = _flood(~solid)
    edge = np.ones(holes.shape, bool)
    edge[1:-1, 1:-1, 1:-1] = False
    want = solid | (~np.isin(holes, np.unique(holes[edge & (holes > 0)])) & (holes > 0))
    assert label.max() > 1 and want.sum() > solid.sum()
    assert {(r.x, r.y, r.z) for r in volumes.voxel_rows(got, 8).where("v = 1").collect()} == {(x, y, z) for z, y, x in np.argwhere(want).tolist()}


def test_parts_across_bricks(spark):
    from corrvox.operators import masks
    from corrvox.operators.tables import cut

    rng = np.random.default_rng(15)
    for density, shape in ((0.35, (9, 14, 11)), (0.6, (4, 4, 4)), (0.0, (5, 5, 5))):
        a = rng.random(shape[::-1]) < density
        rows = [(int(x), int(y), int(z), 1) for z, y, x in np.argwhere(a)]
        mask = volumes.bricks_of_voxels(spark.createDataFrame(rows, "x int, y int, z int, v int"), shape, 4, "u1")
        sizes = sorted(r["sum(voxels)"] for r in masks.parts(mask, shape, 4, cut).groupBy("part").sum("voxels").collect())
        assert sizes == sorted(np.bincount(_flood(a).ravel())[1:].tolist())


def test_digests(spark, tmp_path):
    import hashlib

    from corrvox.operators import digests

    rows = [(i * 7, f"t{i}" if i % 5 else None, i / 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k long, t string, v double")
    one = digests.table_digest(df, "k", ["t", "v"]).first()["digest"]
    assert one == digests.table_digest(df.repartition(7, "t"), "k", ["t", "v"]).first()["digest"]
    other = df.withColumn("t", F.when(F.col("k") == 70_007, "x").otherwise(F.col("t")))
    assert one != digests.table_digest(other, "k", ["t", "v"]).first()["digest"] and one != digests.table_digest(df.where("k <> 14"), "k", ["t", "v"]).first()["digest"]
    assert [tuple(r) for r in digests.differing_ranges(df, other, "k", ["t", "v"]).collect()] == [(70_007 // 1024 * 1024, 70_007 // 1024 * 1024 + 1023)]
    assert len(digests.table_levels(df, "k", ["t"])) == 3 and digests.table_digest(df.limit(0), "k", ["t"]).collect() == []
    data = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(data)
    want = hashlib.sha256("".join(hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)).encode()).hexdigest()
    assert digests.file_digest(spark, str(tmp_path / "f"), 1000) == want
