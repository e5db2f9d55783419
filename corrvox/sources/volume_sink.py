"""Writing volumes: a data source writer for zarr arrays, OME-Zarr images with a pyramid of levels, raw files.

``bricks.write.format("volume").mode("append").options(path=, shape=, dtype=, brick=, shard=).save()`` writes one zarr v3
array whose chunks are the bricks. Rows must come by shard (``by_shard`` deals them so). Each task writes its shards under a
name of the attempt; the driver's commit counts the chunks, moves the winners' files and publishes the array's metadata
last. A failed task or an aborted job leaves nothing behind, and neither does a repeated attempt.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from corrvox.sources import files
from corrvox.sources.volumes import COLUMNS, NOT_STORED, SCHEMA, register

LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum that closes a shard's index."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


class Grid:
    """Sizes along z, y, x: of a chunk, chunks in all, chunks in a shard, shards in all."""

    def __init__(self, shape: tuple[int, int, int], brick: int, shard: int) -> None:
        back = shape[::-1]
        self.chunk = [min(brick, n) for n in back]
        self.chunks = [-(-n // c) for n, c in zip(back, self.chunk, strict=True)]
        self.per = [min(shard, g) for g in self.chunks]
        self.shards = [-(-g // p) for g, p in zip(self.chunks, self.per, strict=True)]


def array_metadata(shape, dtype: str, grid: Grid, level: int) -> dict:
    inner = [LITTLE, {"name": "zstd", "configuration": {"level": level, "checksum": False}}]
    sharding = {"chunk_shape": grid.chunk, "codecs": inner, "index_codecs": [LITTLE, {"name": "crc32c"}], "index_location": "end"}
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape[::-1]), "data_type": np.dtype(dtype).name, "fill_value": 0, "dimension_names": ["z", "y", "x"], "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [c * p for c, p in zip(grid.chunk, grid.per, strict=True)]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": sharding}],
    }


def group_metadata(name: str, levels: int) -> dict:
    scales = [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [float(1 << k)] * 3}]} for k in range(levels)]
    image = {"name": name, "axes": [{"name": a, "type": "space"} for a in "zyx"], "datasets": scales}
    return {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [image]}}}


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: the attempt's folder, and for each shard its place and its number of chunks."""

    folder: str
    shards: list[tuple[tuple[int, int, int], int]]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        missing = [k for k in ("path", "shape", "dtype", "brick") if k not in options]
        if missing or columns != COLUMNS:
            raise ValueError(f"a volume is written from the columns {', '.join(COLUMNS)} with the options path, shape, dtype and brick")
        self.path, self.dtype = options["path"].rstrip("/"), np.dtype(options["dtype"]).newbyteorder("<").str
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.grid, self.level = Grid(self.shape, int(options["brick"]), int(options.get("shard", "8"))), int(options.get("level", "3"))
        self.stage = f"{self.path}.stage-{uuid.uuid4().hex}"
        if files.kind(self.path):
            raise FileExistsError(f"{self.path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        pack, grid = zstandard.ZstdCompressor(level=self.level), self.grid
        folder, done, at, body, index = f"{self.stage}/{uuid.uuid4().hex}", [], None, None, None

        def close() -> None:
            if at is not None:
                tail = struct.pack(f"<{2 * len(index)}Q", *[v for pair in index for v in pair])
                body.write(tail + struct.pack("<I", crc32c(tail)))
                body.close()
                done.append((at, sum(pair[0] != NOT_STORED for pair in index)))

        for batch in iterator:
            for bx, by, bz, nx, ny, nz, stored, data in zip(*[batch.column(c).to_pylist() for c in COLUMNS], strict=True):
                here = tuple(k // p for k, p in zip((bz, by, bx), grid.per, strict=True))
                if here != at:
                    close()
                    if here in {p for p, _ in done}:
                        raise ValueError(f"the bricks of shard {here} don't come together")
                    at, index, offset = here, [(NOT_STORED, NOT_STORED)] * math.prod(grid.per), 0
                    fs, p = files.place(f"{folder}/{'_'.join(map(str, at))}")
                    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    body = fs.open_output_stream(p)
                k = int(np.ravel_multi_index([k % p for k, p in zip((bz, by, bx), grid.per, strict=True)], grid.per))
                if index[k][0] != NOT_STORED:
                    raise ValueError(f"brick {bx}, {by}, {bz} comes twice")
                whole = np.zeros(grid.chunk, self.dtype)
                whole[:nz, :ny, :nx] = np.frombuffer(data, stored).reshape(nz, ny, nx)
                raw = pack.compress(whole.tobytes())
                body.write(raw)
                index[k] = (offset, len(raw))
                offset += len(raw)
        close()
        return Written(folder, done)

    def commit(self, messages: list[Written | None]) -> None:
        told = [(m.folder, at, n) for m in messages if m is not None for at, n in m.shards]
        have, want = sum(n for _, _, n in told), math.prod(self.grid.chunks)
        try:
            if have != want or len({at for _, at, _ in told}) != len(told):
                raise ValueError(f"{self.path}: {have} of {want} bricks came, in {len(told)} of {math.prod(self.grid.shards)} shards")
            fs, p = files.place(f"{self.stage}/array/c")
            for z, y in {at[:2] for _, at, _ in told}:
                fs.create_dir(f"{p}/{z}/{y}", recursive=True)
            for folder, at, _ in told:
                files.move(f"{folder}/{'_'.join(map(str, at))}", f"{self.stage}/array/c/{'/'.join(map(str, at))}")
            files.write(f"{self.stage}/array/zarr.json", json.dumps(array_metadata(self.shape, self.dtype, self.grid, self.level), indent=1).encode())
            files.move(f"{self.stage}/array", self.path)
        finally:
            files.delete(self.stage)

    def abort(self, messages: list[Written | None]) -> None:
        files.delete(self.stage)


def by_shard(bricks: DataFrame, shape: tuple[int, int, int], brick: int, shard: int) -> DataFrame:
    grid = Grid(shape, brick, shard)
    keys = [F.floor(F.col(f"b{a}") / p).alias(f"s{a}") for a, p in zip("zyx", grid.per, strict=True)]
    dealt = bricks.select(*COLUMNS, *keys).repartition(min(math.prod(grid.shards), 10_000), "sz", "sy", "sx").sortWithinPartitions("sz", "sy", "sx", "bz", "by", "bx")
    return dealt.select(*COLUMNS)


def write_array(bricks: DataFrame, shape: tuple[int, int, int], dtype: str, brick: int, path: str, shard: int = 8, level: int = 3) -> None:
    """One zarr array at ``path``, which must be free. One shuffle by shard; a task holds a batch of bricks at a time."""
    register(bricks.sparkSession)
    options = {"path": path, "shape": ",".join(map(str, shape)), "dtype": dtype, "brick": str(brick), "shard": str(shard), "level": str(level)}
    by_shard(bricks, shape, brick, shard).write.format("volume").mode("append").options(**options).save()


def halved(bricks: DataFrame, brick: int) -> DataFrame:
    """The next level of a pyramid: means of 2 x 2 x 2 voxels (at the edges of what there is), rounded to even in whole-number types.

    ``brick`` is even, so each brick shrinks by itself; eight shrunk bricks, an eighth of the data, meet in their parent.
    """
    if brick % 2:
        raise ValueError("levels need an even brick size")
    half = brick // 2

    def shrink(batches):
        for b in batches:
            out = []
            for bx, by, bz, nx, ny, nz, dtype, data in b[COLUMNS].itertuples(index=False, name=None):
                total, count = np.frombuffer(data, dtype).reshape(nz, ny, nx).astype(float), np.ones((nz, ny, nx))
                for axis, n in enumerate((nz, ny, nx)):
                    total, count = (np.add.reduceat(a, np.arange(0, n, 2), axis=axis) for a in (total, count))
                mean = total / count
                mean = (mean if np.dtype(dtype).kind == "f" else np.rint(mean)).astype(dtype)
                out.append((bx, by, bz, *mean.shape[::-1], dtype, mean.tobytes()))
            yield pd.DataFrame(out, columns=COLUMNS)

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        px, py, pz = key
        ends = [max((r[f"b{a}"] - 2 * p) * half + r[f"n{a}"] for _, r in rows.iterrows()) for a, p in zip("zyx", (pz, py, px), strict=True)]
        whole = np.zeros(ends, rows["dtype"].iloc[0])
        for bx, by, bz, nx, ny, nz, dtype, data in rows[COLUMNS].itertuples(index=False, name=None):
            z, y, x = ((b - 2 * p) * half for b, p in zip((bz, by, bx), (pz, py, px), strict=True))
            whole[z : z + nz, y : y + ny, x : x + nx] = np.frombuffer(data, dtype).reshape(nz, ny, nx)
        return pd.DataFrame([(px, py, pz, *whole.shape[::-1], whole.dtype.str, whole.tobytes())], columns=COLUMNS)

    parent = [F.floor(F.col(f"b{a}") / 2).cast("int").alias(f"p{a}") for a in "xyz"]
    return bricks.mapInPandas(shrink, SCHEMA).groupBy(*parent).applyInPandas(join, SCHEMA)


def write_zarr(bricks: DataFrame, shape: tuple[int, int, int], dtype: str, brick: int, path: str, shard: int = 8, level: int = 3, overwrite: bool = False, levels: int = 1) -> None:
    """An OME-Zarr v3 image of ``levels`` levels, each made from the one before as it was written.

    Every chunk is stored, empty ones too, and edge chunks are filled up with 0. The image appears under its name when it is
    whole; an absent brick is an error. An existing ``path`` is one too, unless ``overwrite`` is set and it is a zarr store.
    """
    path = path.rstrip("/")
    old = files.kind(path)
    if old and not (overwrite and files.kind(f"{path}/zarr.json")):
        raise FileExistsError(f"{path} exists" + (" and is not a zarr store" if overwrite else ""))
    part, spark = f"{path}.part-{uuid.uuid4().hex}", bricks.sparkSession
    try:
        files.place(part)[0].create_dir(files.place(part)[1], recursive=True)
        for k in range(levels):
            if k:
                bricks = halved(spark.read.format("volume").options(path=f"{part}/{k - 1}", brick=str(brick)).load(), brick)
                shape = tuple(-(-n // 2) for n in shape)
            write_array(bricks, shape, dtype, brick, f"{part}/{k}", shard, level)
        files.write(f"{part}/zarr.json", json.dumps(group_metadata(path.rsplit("/", 1)[-1], levels), indent=1).encode())
        if old:
            files.move(path, f"{part}.old")
        files.move(part, path)
        files.delete(f"{part}.old")
    finally:
        files.delete(part)


def write_raw(bricks: DataFrame, shape: tuple[int, int, int], dtype: str, brick: int, path: str) -> None:
    """One little-endian raw file on a mount that all machines share: every task writes its bricks' rows at their places.

    A repeated attempt writes the same bytes again. The file appears under its name when all bricks are there.
    """
    part, (nx, ny, nz), kind = f"{path}.part-{uuid.uuid4().hex}", shape, np.dtype(dtype).newbyteorder("<")

    def run(batches):
        file, done = os.open(part, os.O_WRONLY), 0
        try:
            for b in batches:
                for bx, by, bz, mx, my, mz, stored, data in b[COLUMNS].itertuples(index=False, name=None):
                    a = np.frombuffer(data, stored).astype(kind).reshape(mz, my, mx)
                    for k, j in np.ndindex(mz, my):
                        os.pwrite(file, a[k, j].tobytes(), (((bz * brick + k) * ny + by * brick + j) * nx + bx * brick) * kind.itemsize)
                    done += a.size
            os.fsync(file)
        finally:
            os.close(file)
        yield pd.DataFrame({"voxels": [done]})

    if os.path.exists(path):
        raise FileExistsError(f"{path} exists")
    try:
        with open(part, "wb") as f:
            f.truncate(math.prod(shape) * kind.itemsize)
        done = bricks.dropDuplicates(["bx", "by", "bz"]).mapInPandas(run, "voxels long").agg(F.sum("voxels")).first()[0] or 0
        if done != math.prod(shape):
            raise ValueError(f"{path}: {done} of {math.prod(shape)} voxels came")
        os.replace(part, path)
    finally:
        files.delete(part)
