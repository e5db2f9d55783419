"""Runs from settings to files: plan, solve what isn't written yet, finish, report."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.config import RunConfig
from corrvox.operators import metrics, seeding, strain, tiling
from corrvox.operators.knn import median_spacing
from corrvox.operators.seeding import with_distance
from corrvox.operators.tables import Shelves
from corrvox.plans import correlate as c
from corrvox.sources import archive, files, text
from corrvox.sources.volumes import in_box, layout, missing_chunks, read_bricks

C = F.col


def _options(cfg: RunConfig) -> dict[str, str]:
    v = cfg.volumes
    out = {"header": str(v.raw_header_bytes)}
    if v.raw_shape_xyz:
        out["shape"] = ",".join(map(str, v.raw_shape_xyz))
    if v.raw_dtype:
        out["dtype"] = v.raw_dtype
    return out


def cut_to(spark: SparkSession, folder: str):
    """A function that writes rows below ``folder`` and reads them back, so that loops keep no lineage."""

    def cut(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut


class Store:
    """Results as a Parquet table by part (shell, or layer of tiles) and tile that grows step by step: each step is one committed job.

    A step solves only points without a result, so a run that was stopped goes on where it was, and rows that a
    stopped commit left visible are not solved twice. A step reads the results of its own parts only.
    """

    def __init__(self, spark: SparkSession, cfg: RunConfig, path: str, cut) -> None:
        self.spark, self.cfg, self.path, self.cut = spark, cfg, path, cut
        v, shapes = cfg.volumes, [layout(p, {"path": p} | _options(cfg))["shape"] for p in (cfg.volumes.reference, cfg.volumes.deformed)]
        if shapes[0] != shapes[1]:
            raise ValueError(f"the volumes have different shapes: {shapes[0]} and {shapes[1]}")
        for p in (v.reference, v.deformed):
            if files.kind(p) == "folder":
                missing_chunks(spark, p)
        self.plan = {"shape": tuple(shapes[0]), "offsets": cfg.offsets(), "search": cfg.kernel(), "tile": cfg.cluster.tile, "brick": cfg.cluster.brick, "sigma": v.prefilter_sigma, "most": cfg.cluster.tile_points or None, "cut": cut}
        self.far = c.reach(self.plan["offsets"], self.plan["search"], v.prefilter_sigma)
        self.shelves = Shelves(spark, path, "part", f"{c.OUT}, part int, tile string")

    def rows(self, *parts: int) -> DataFrame:
        return self.shelves.get(*parts)

    def solve(self, seeds: DataFrame, part: int) -> DataFrame:
        """Solve and commit what has no result yet in a part; returns the part's results."""
        self._solve(seeds.withColumn("part", F.lit(part)), [part])
        return self.rows(part)

    def _solve(self, seeds: DataFrame, parts: list[int]) -> None:
        cfg, v = self.cfg, self.cfg.volumes
        # Written first: the job that appends to the store doesn't read it.
        left = self.cut(seeds.join(self.rows(*parts).select("point_id"), "point_id", "left_anti"))
        box = c.reach_box(left, self.far)
        if box:
            self._guard(left)
            image = lambda path: in_box(read_bricks(self.spark, path, cfg.cluster.brick, **_options(cfg)), *box, cfg.cluster.brick)
            out = c.correlate(left, ref=image(v.reference), deformed=image(v.deformed), **self.plan)
            named = tiling.tile_of(out, cfg.cluster.tile).withColumn("tile", F.concat_ws("_", "tx", "ty", "tz"))
            part = F.lit(parts[0]) if len(parts) == 1 else C("tz")
            named.withColumn("part", part).drop("tx", "ty", "tz").write.mode("append").partitionBy("part", "tile").parquet(self.path)

    def _guard(self, points: DataFrame) -> None:
        """Refuse a tile whose images don't fit a task; only the plan is computed, no voxel is read."""
        tile, limit = self.cfg.cluster.tile, self.cfg.cluster.task_mb
        # Both images in doubles; a blur holds a second copy.
        worst = tiling.largest_task(tiling.plan(points, tile, self.far, 1.0), 16 if self.cfg.volumes.prefilter_sigma > 0 else 8).first()
        if worst["bytes"] > limit * 2**20:
            raise ValueError(f"the images of tile ({worst['tx']}, {worst['ty']}, {worst['tz']}) take {worst['bytes'] / 2**20:.0f} MB, cluster.task_mb is {limit}: make cluster.tile ({tile:g}) smaller or seeds less far apart")

    def solve_by_layers(self, seeds: DataFrame, step_points: int) -> None:
        """Steps of whole layers of tiles, as many to a step as hold ``step_points`` points (one at least)."""
        layer = F.floor(C("z") / self.cfg.cluster.tile).cast("int")
        counts = seeds.groupBy(layer.alias("tz")).agg(F.count(F.lit(1)).alias("n")).orderBy("tz").collect()  # a row for each layer of tiles
        step: list[int] = []
        held = 0
        for k, r in enumerate(counts):
            step, held = [*step, r["tz"]], held + r["n"]
            if k + 1 == len(counts) or held + counts[k + 1]["n"] > step_points:
                self._solve(seeds.where(layer.between(step[0], step[-1])), step)
                step, held = [], 0


def run(spark: SparkSession, cfg: RunConfig, step_points: int = 2_000_000) -> DataFrame:
    """Solve all points of a configured run; results are a Parquet table by tile at ``<output>/results``.

    Results are committed in steps: shells of a wavefront, layers of tiles of about ``step_points`` points otherwise. A run
    that was stopped goes on with the points that have no result; seeds come from stored results, so it ends with the
    results of a run that wasn't stopped. Its settings must be the same: a fingerprint is kept beside the results, and
    another one is refused.
    """
    finger, place = cfg.fingerprint(), f"{cfg.output}/fingerprint.json"
    if archive.exists(spark, place):
        was = json.loads(archive.read_bytes(spark, place))
        differ = sorted(k for k in was.keys() | finger.keys() if was.get(k) != finger.get(k))
        if differ:
            raise ValueError(f"{cfg.output} holds results of other settings: {', '.join(differ)}")
    work = f"{cfg.output}/work/{uuid.uuid4().hex}"
    cut = cut_to(spark, work)
    store = Store(spark, cfg, f"{cfg.output}/results", cut)
    archive.write_bytes(spark, place, json.dumps(finger, indent=1).encode(), overwrite=True)
    try:
        pts = cut(text.read_points(spark, cfg.points))
        first = pts.orderBy("input_idx").first()
        start = cfg.seeding.start or (first["x"], first["y"], first["z"])
        if cfg.num_points_to_process:
            pts = cut(with_distance(pts, start).orderBy("distance", "input_idx").limit(cfg.num_points_to_process).drop("distance"))
        pts = pts.select("point_id", "x", "y", "z")
        rigid, s = cfg.search.rigid_trans, cfg.seeding
        if s.strategy == "rigid" or pts.limit(2).count() < 2:
            store.solve_by_layers(c.rigid_seeds(pts, rigid), step_points)
            return store.rows()
        width = s.shell_width or median_spacing(pts, 32.0).first()["spacing"]
        if s.strategy == "wavefront":
            c.wavefront(pts, start, width, s.neighbours, 2 * width, cut, rigid, store.solve, work)
        else:
            far, some = width * s.coarse_stride, Store(spark, cfg, f"{cfg.output}/coarse", cut)
            field = c.wavefront(seeding.coarse_subset(pts, s.coarse_stride, width), start, far, s.neighbours, 2 * far, cut, rigid, some.solve, work)
            store.solve_by_layers(cut(pts.join(seeding.interpolate_seeds(pts, field, 8, 2 * far, rigid), "point_id")), step_points)
        return store.rows()
    finally:
        archive.remove(spark, work)


def finish(spark: SparkSession, cfg: RunConfig, seconds: float, partial: bool = False) -> None:
    """Write the result file and the summary; points without a result are an error unless ``partial``."""
    results = spark.read.parquet(f"{cfg.output}/results")
    pts = text.read_points(spark, cfg.points).select("point_id", "x", "y", "z")
    whole = tiling.finalize(results, pts, partial)
    rows = whole.select("point_id", "status", *"uvw").join(pts, "point_id").join(results.select("point_id", "objmin"), "point_id", "left")
    lines = text.result_lines(rows, plain=False).select((C("point_id") + 1).alias("place"), "line")
    head = spark.createDataFrame([(-(1 << 62), "\t".join(text.DISP_COLUMNS))], "place long, line string")
    text.write_lines(head.unionByName(lines), f"{cfg.output}/disp", "place")
    text.write_lines(text.stat_lines(rows, seconds), f"{cfg.output}/stat", "place")


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of any kind: a Parquet store or a result file."""
    return text.read_results(spark, path) if archive.is_file(spark, path) else spark.read.parquet(path)


def compare(spark: SparkSession, a: str, b: str) -> DataFrame:
    return metrics.accuracy(load_results(spark, a), load_results(spark, b).select("point_id", "u", "v", "w"))


def write_strain(spark: SparkSession, results: str, out: str, window: int = 25, cell: float = 32.0) -> None:
    """Strain of a result as CSV (``nan`` where the window doesn't determine it)."""
    s = strain.strain(load_results(spark, results), window, cell)
    s.select("point_id", "pts_in_sw", "sw_radius", "u_fit", "v_fit", "w_fit", *strain.NAMES, "ep1", "ep2", "ep3", *[f"sd_{n}" for n in strain.NAMES]).write.option("header", True).option("nanValue", "nan").csv(out)
