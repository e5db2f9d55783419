"""Image volumes as tables of bricks: a Spark data source that opens only the bricks a query asks for.

A brick row is ``bx, by, bz`` (its place), ``nx, ny, nz`` (its size), ``dtype`` and ``data`` (C order, z
slowest, native bytes). ``spark.read.format("volume").option("path", ...)`` reads raw, MetaImage, npy and
OME-Zarr v3. Comparisons of ``bx``, ``by`` and ``bz`` with constants reach the source (``pushFilters``): bricks outside
are not planned, so a box of a volume costs its bricks. Tasks hold whole rows of bricks of about ``task_mb`` each.
Files are opened by the executors (``sources.files``): on a mount that all machines share, or by URI.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from corrvox.sources import files

SCHEMA = "bx int, by int, bz int, nx int, ny int, nz int, dtype string, data binary"
COLUMNS = ["bx", "by", "bz", "nx", "ny", "nz", "dtype", "data"]

# MetaImage element types.
MHD_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
# Header fields that matter here, what holds where one is absent (None: it must be there), and the values that can be read.
MHD_FIELDS = {
    "NDims": ("3", r"3"),
    "DimSize": (None, r"\d+\s+\d+\s+\d+"),
    "HeaderSize": ("0", r"\d+"),
    "ElementType": (None, "|".join(MHD_TYPES)),
    "ElementNumberOfChannels": ("1", r"1"),
    "CompressedData": ("False", r"(?i:false)"),
    "BinaryDataByteOrderMSB": ("", r"(?i:true|false|)"),
    "ElementByteOrderMSB": ("False", r"(?i:true|false)"),
    "ElementDataFile": (None, r"(?!LOCAL$|LIST$)[^%]+"),
}


def mhd_layout(path: str) -> dict:
    """File, shape (x, y, z), dtype and header bytes of a MetaImage header; all fields that can't be read are named."""
    given = dict(re.findall(r"^\s*(\w+)\s*=[ \t]*(.*?)\s*$", files.read(path).decode("utf-8", "replace"), re.MULTILINE))
    held = {k: given.get(k, absent) for k, (absent, _) in MHD_FIELDS.items()}
    bad = [f"{k} = {held[k]}" if k in given else f"no {k}" for k, (_, fits) in MHD_FIELDS.items() if held[k] is None or not re.fullmatch(fits, held[k])]
    if bad:
        raise ValueError(f"{path}: only uncompressed 3-D images of one channel in a file of their own are read; it has {', '.join(bad)}")
    order = ">" if (held["BinaryDataByteOrderMSB"] or held["ElementByteOrderMSB"]).lower() == "true" else "<"
    folder = path[: path.rfind("/") + 1]
    return {"file": folder + held["ElementDataFile"], "shape": [int(n) for n in held["DimSize"].split()], "dtype": order + MHD_TYPES[held["ElementType"]], "header": int(held["HeaderSize"])}


def npy_layout(path: str) -> dict:
    fs, p = files.place(path)
    with fs.open_input_stream(p) as f:
        head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 3:
        raise ValueError(f"{path}: not a 3-D array")
    return {"file": path, "shape": list(shape[::-1]), "dtype": dtype.str, "header": head.tell(), "z_first": fortran}


def layout(path: str, options: dict) -> dict:
    """How to read a volume: file, shape (x, y, z), dtype, header bytes, order; or a zarr array."""
    if files.kind(path) == "folder":
        return zarr_layout(path, options.get("level", "0"))
    if path.endswith(".mhd"):
        out = mhd_layout(path)
    elif path.endswith(".npy"):
        out = npy_layout(path)
    elif "shape" in options and "dtype" in options:
        out = {"file": path, "shape": [int(v) for v in options["shape"].split(",")], "dtype": options["dtype"], "header": int(options.get("header", "0"))}
    else:
        raise ValueError(f"{path}: raw volumes need the options shape (x,y,z) and dtype")
    want = out["header"] + math.prod(out["shape"]) * np.dtype(out["dtype"]).itemsize
    have = files.size(out["file"])
    if have != want:
        raise ValueError(f"{out['file']}: {have} bytes, but shape, type and header say {want} ({'too short' if have < want else 'too long'})")
    return out


def zarr_layout(path: str, level: str) -> dict:
    root = path.rstrip("/")
    meta = json.loads(files.read(f"{root}/zarr.json"))
    if meta.get("node_type") == "group":
        root = f"{root}/{level}"
        meta = json.loads(files.read(f"{root}/zarr.json"))
    if meta.get("zarr_format") != 3 or len(meta["shape"]) != 3:
        raise ValueError(f"{path}: not a 3-D zarr v3 array")
    chunk, codecs, shard = meta["chunk_grid"]["configuration"]["chunk_shape"], meta["codecs"], None
    if codecs[0]["name"] == "sharding_indexed":
        c = codecs[0]["configuration"]
        shard, chunk, codecs = chunk, c["chunk_shape"], c["codecs"]
        index = {"end": c.get("index_location", "end") == "end", "crc": any(x["name"] == "crc32c" for x in c["index_codecs"])}
    names = [c["name"] for c in codecs]
    if not set(names) <= {"bytes", "zstd", "gzip"}:
        raise ValueError(f"{path}: codecs {names} aren't supported")
    endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
    dtype = np.dtype(meta["data_type"]).newbyteorder("<" if endian == "little" else ">").str
    sep = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    return {"zarr": root, "shape": meta["shape"][::-1], "dtype": dtype, "chunk": chunk, "shard": shard, "index": index if shard else None, "packed": next((n for n in names if n != "bytes"), None), "sep": sep, "fill": meta.get("fill_value", 0)}


def _unpack(lay: dict, raw: bytes) -> np.ndarray:
    n = math.prod(lay["chunk"]) * np.dtype(lay["dtype"]).itemsize
    if lay["packed"] == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=n)
    elif lay["packed"] == "gzip":
        import gzip

        raw = gzip.decompress(raw)
    return np.frombuffer(raw, lay["dtype"]).reshape(lay["chunk"])


NOT_STORED = (1 << 64) - 1


def shard_index(lay: dict, name: str, count: int) -> np.ndarray | None:
    """Offsets and lengths of a shard's ``count`` chunks; None if there is no such file."""
    if files.kind(name) is None:
        return None
    fs, p = files.place(name)
    size = 16 * count + 4 * lay["index"]["crc"]
    with fs.open_input_file(p) as f:
        raw = f.read_at(16 * count, f.size() - size if lay["index"]["end"] else 0)
    return np.frombuffer(raw, "<u8").reshape(count, 2)


def chunk_name(lay: dict, at: Iterable[int]) -> str:
    return f"{lay['zarr']}/c{lay['sep']}{lay['sep'].join(str(int(k)) for k in at)}"


class ZarrChunks:
    """Chunks of one array; the index of the shard that was read last is kept."""

    def __init__(self, lay: dict) -> None:
        self.lay, self.name, self.index = lay, None, None

    def get(self, at: tuple[int, int, int]) -> np.ndarray | None:
        """A chunk by its (z, y, x) place, None if it isn't stored."""
        lay = self.lay
        if not lay["shard"]:
            name = chunk_name(lay, at)
            return _unpack(lay, files.read(name)) if files.kind(name) else None
        per = [s // c for s, c in zip(lay["shard"], lay["chunk"], strict=True)]
        name = chunk_name(lay, [k // p for k, p in zip(at, per, strict=True)])
        if name != self.name:
            self.name, self.index = name, shard_index(lay, name, math.prod(per))
        k = np.ravel_multi_index([k % p for k, p in zip(at, per, strict=True)], per)
        if self.index is None or (self.index[k] == NOT_STORED).all():
            return None
        offset, length = map(int, self.index[k])
        fs, p = files.place(name)
        with fs.open_input_file(p) as f:
            return _unpack(lay, f.read_at(length, offset))


def _overlap(lo: int, hi: int, base: int, n: int) -> tuple[slice, slice]:
    """Where [lo, hi) and [base, base + n) overlap, in the second and in the first."""
    a, b = max(lo, base), max(lo, base, min(hi, base + n))
    return slice(a - base, b - base), slice(a - lo, b - lo)


def _flat_box(f, lay: dict, shape: list[int], lo, hi) -> np.ndarray:
    """[lo, hi) of a flat file whose axes are given fastest first; the result's axes are slowest first."""
    dtype, (n0, n1, _) = np.dtype(lay["dtype"]), shape
    (a0, a1, a2), (b0, b1, b2) = lo, hi
    out = np.empty((b2 - a2, b1 - a1, b0 - a0), dtype)
    narrow = 4 * (b0 - a0) < n0
    for k in range(a2, b2):
        if narrow:
            for j in range(a1, b1):
                raw = f.read_at((b0 - a0) * dtype.itemsize, lay["header"] + ((k * n1 + j) * n0 + a0) * dtype.itemsize)
                out[k - a2, j - a1] = np.frombuffer(raw, dtype)
        else:  # the plane's rows at once, with what lies between them
            raw = np.frombuffer(f.read_at(((b1 - a1 - 1) * n0 + b0 - a0) * dtype.itemsize, lay["header"] + ((k * n1 + a1) * n0 + a0) * dtype.itemsize), dtype)
            out[k - a2] = np.lib.stride_tricks.as_strided(raw, (b1 - a1, b0 - a0), (n0 * dtype.itemsize, dtype.itemsize))
    return out


def box_reader(lay: dict):
    """A function of (lo, hi), x, y, z inside the volume, that returns its voxels (z, y, x); not finite ones are an error."""
    dtype = np.dtype(lay["dtype"])
    if "zarr" in lay:
        chunks = ZarrChunks(lay)

        def read(lo, hi):
            a, b, c = lo[::-1], hi[::-1], lay["chunk"]
            out = np.full([q - p for p, q in zip(a, b, strict=True)], lay["fill"], dtype)
            spans = [range(p // n, (q - 1) // n + 1) for p, q, n in zip(a, b, c, strict=True)]
            for at in ((i, j, k) for i in spans[0] for j in spans[1] for k in spans[2]):
                got = chunks.get(at)
                if got is not None:
                    cut = [_overlap(p, q, k * n, n) for p, q, k, n in zip(a, b, at, c, strict=True)]
                    out[tuple(s for _, s in cut)] = got[tuple(s for s, _ in cut)]
            return out
    else:
        fs, p = files.place(lay["file"])
        f = fs.open_input_file(p)

        def read(lo, hi):
            if lay.get("z_first"):
                return _flat_box(f, lay, lay["shape"][::-1], lo[::-1], hi[::-1]).transpose(2, 1, 0)
            return _flat_box(f, lay, lay["shape"], lo, hi)

    def checked(lo, hi):
        out = read(lo, hi)
        if dtype.kind == "f" and not np.isfinite(out).all():
            raise ValueError("the volume holds values that aren't finite")
        return np.ascontiguousarray(out, dtype.newbyteorder("="))

    return checked


class BrickRows(InputPartition):
    """Rows of bricks for one task: (bz, by, the bx wanted)."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]) -> None:
        self.rows = rows


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.brick = int(options.get("brick", "64"))
        self.lay = layout(options["path"], options)
        self.task_bytes = float(options.get("task_mb", "64")) * (1 << 20)
        self.wanted = {f"b{a}": range(-(-n // self.brick)) for a, n in zip("xyz", self.lay["shape"], strict=True)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the places by comparisons with constants; what isn't understood is left to Spark."""
        tests = {EqualTo: int.__eq__, EqualNullSafe: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__, In: lambda k, values: k in values}
        for f in filters:
            name = getattr(f, "attribute", ())  # a negation has none
            axis = name[0] if len(name) == 1 else None
            if axis not in self.wanted:
                yield f
            elif isinstance(f, IsNotNull):
                continue  # places are never null
            elif type(f) in tests:
                value = set(f.value) if isinstance(f, In) else f.value
                self.wanted[axis] = [] if value is None else [k for k in self.wanted[axis] if tests[type(f)](k, value)]
            else:
                yield f

    def partitions(self) -> list[BrickRows]:
        xs = list(self.wanted["bx"])
        row = max(1, len(xs)) * self.brick**3 * np.dtype(self.lay["dtype"]).itemsize
        rows = [(z, y, xs) for z in self.wanted["bz"] for y in self.wanted["by"]] if xs else []
        per = max(1, int(self.task_bytes // row))
        return [BrickRows(rows[k : k + per]) for k in range(0, len(rows), per)] or [BrickRows([])]

    def read(self, partition: BrickRows) -> Iterator[tuple]:
        read = box_reader(self.lay)
        for bz, by, xs in partition.rows:
            yield from brick_rows(read, self.lay["shape"], self.brick, bz, by, xs)


def brick_rows(read, shape, brick: int, bz: int, by: int, places: Iterable[int] | None = None) -> Iterator[tuple]:
    """Rows of a row of bricks (all, or those at the given bx), with ``read(lo, hi)`` for the voxels."""
    for bx in range(-(-shape[0] // brick)) if places is None else places:
        lo = [k * brick for k in (bx, by, bz)]
        hi = [min(n, k + brick) for n, k in zip(shape, lo, strict=True)]
        a = read(tuple(lo), tuple(hi))
        yield bx, by, bz, *[int(q - p) for p, q in zip(lo, hi, strict=True)], a.dtype.str, a.tobytes()


class VolumeSource(DataSource):
    """``volumes.register(spark)``, then ``spark.read.format("volume")`` or ``CREATE TEMPORARY VIEW v USING volume OPTIONS (...)``."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        from corrvox.sources.volume_sink import VolumeWriter

        return VolumeWriter(dict(self.options), [f.name for f in schema])


def register(spark: SparkSession) -> None:
    """Make ``format("volume")`` known to a session and let comparisons reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)


def read_bricks(spark: SparkSession, path: str, brick: int = 64, **options: str) -> DataFrame:
    """Bricks of a volume in any supported format; filter ``bx``, ``by``, ``bz`` to read only these."""
    register(spark)
    return spark.read.format("volume").options(path=path, brick=str(brick), **options).load()


def in_box(bricks: DataFrame, lo: tuple, hi: tuple, brick: int) -> DataFrame:
    """The bricks that [lo, hi) (x, y, z) touches."""
    keep = F.lit(True)
    for a, p, q in zip("xyz", lo, hi, strict=True):
        keep = keep & (F.col(f"b{a}") >= max(0, math.floor(p / brick))) & (F.col(f"b{a}") <= (math.ceil(q) - 1) // brick)
    return bricks.where(keep)


def convert(bricks: DataFrame, path: str, mode: str = "error") -> None:
    """Store bricks as Parquet by layer, so that a box reads only the layers and places it covers."""
    bricks.repartition("bz").sortWithinPartitions("by", "bx").write.mode(mode).partitionBy("bz").parquet(path)


def missing_chunks(spark: SparkSession, path: str, level: str = "0") -> int:
    """How many chunks of a zarr image aren't stored (they read as the fill value), with a warning if any; only indexes are read."""
    lay = zarr_layout(path, level)
    grid = [-(-n // c) for n, c in zip(lay["shape"][::-1], lay["chunk"], strict=True)]
    per = [s // c for s, c in zip(lay["shard"] or lay["chunk"], lay["chunk"], strict=True)]
    shards = [-(-g // p) for g, p in zip(grid, per, strict=True)]

    def stored(at) -> int:
        if not lay["shard"]:
            return int(files.kind(chunk_name(lay, at)) is not None)
        index = shard_index(lay, chunk_name(lay, at), math.prod(per))
        return 0 if index is None else int((index != NOT_STORED).any(1).sum())

    def run(batches):
        for b in batches:
            missing = 0
            for k in b["id"]:
                at = np.unravel_index(int(k), shards)
                # Chunks of the last files that lie outside the image don't count.
                inside = math.prod(min(p, g - int(o) * p) for o, p, g in zip(at, per, grid, strict=True))
                missing += inside - min(inside, stored(at))
            yield pd.DataFrame({"missing": [missing]})

    n = math.prod(shards)
    missing = spark.range(0, n, 1, min(n, 256)).mapInPandas(run, "missing long").agg(F.sum("missing")).first()[0]
    if missing:
        warnings.warn(f"{path}: {missing} of {math.prod(grid)} chunks aren't stored and read as {lay['fill']}; the image may be incomplete", stacklevel=2)
    return missing


def assemble(rows, lo: tuple, hi: tuple, brick: int) -> np.ndarray:
    """The voxels of [lo, hi) (x, y, z) from brick rows, as float64 (z, y, x)."""
    a, b = lo[::-1], hi[::-1]
    out = np.full([q - p for p, q in zip(a, b, strict=True)], np.nan)
    for bx, by, bz, nx, ny, nz, dtype, data in rows:
        cut = [_overlap(p, q, k * brick, n) for p, q, k, n in zip(a, b, (bz, by, bx), (nz, ny, nx), strict=True)]
        out[tuple(s for _, s in cut)] = np.frombuffer(data, dtype).reshape(nz, ny, nx)[tuple(s for s, _ in cut)]
    return out


def voxel_rows(bricks: DataFrame, brick: int, lo: tuple | None = None, hi: tuple | None = None) -> DataFrame:
    """(x, y, z, v): a row for each voxel, of the whole volume or of [lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in COLUMNS], strict=True):
                bx, by, bz, nx, ny, nz, dtype, data = r
                z, y, x = (g.ravel() + b * brick for g, b in zip(np.indices((nz, ny, nx), np.int32), (bz, by, bx), strict=True))
                v = np.frombuffer(data, dtype).astype(float)
                if lo is not None:
                    keep = np.all([(p <= c) & (c < q) for c, p, q in zip((x, y, z), lo, hi, strict=True)], axis=0)
                    x, y, z, v = x[keep], y[keep], z[keep], v[keep]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (x, y, z)] + [pa.array(v)], names=["x", "y", "z", "v"])

    return bricks.select(*COLUMNS).mapInArrow(run, "x int, y int, z int, v double")


def bricks_of_voxels(voxels: DataFrame, shape: tuple[int, int, int], brick: int, dtype: str) -> DataFrame:
    """Bricks from (x, y, z, v), places inside ``shape``; voxels without a row are 0. One shuffle, a brick meets in a task."""
    place = [F.floor(F.col(a) / brick).cast("int").alias(f"b{a}") for a in "xyz"]

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        lo = [int(k) * brick for k in key]
        n = [min(brick, m - p) for m, p in zip(shape, lo, strict=True)]
        out = np.zeros(n[::-1], dtype)
        x, y, z = (rows[a].to_numpy() - p for a, p in zip("xyz", lo, strict=True))
        out[z, y, x] = rows["v"].to_numpy()
        return pd.DataFrame([(*[int(k) for k in key], *n, out.dtype.str, out.tobytes())], columns=COLUMNS)

    filled = voxels.select("x", "y", "z", "v", *place).groupBy("bx", "by", "bz").applyInPandas(fill, SCHEMA)
    counts = [-(-n // brick) for n in shape]
    ids = voxels.sparkSession.range(math.prod(counts))
    places = ids.select((F.col("id") % counts[0]).cast("int").alias("bx"), (F.floor(F.col("id") / counts[0]) % counts[1]).cast("int").alias("by"), F.floor(F.col("id") / (counts[0] * counts[1])).cast("int").alias("bz"))

    def empty(batches):
        for b in batches:
            rows = []
            for place in b[["bx", "by", "bz"]].itertuples(index=False, name=None):
                n = [min(brick, m - k * brick) for m, k in zip(shape, place, strict=True)]
                rows.append((*place, *n, np.dtype(dtype).str, bytes(math.prod(n) * np.dtype(dtype).itemsize)))
            yield pd.DataFrame(rows, columns=COLUMNS)

    absent = places.join(voxels.select(*place).distinct(), ["bx", "by", "bz"], "left_anti")
    return filled.unionByName(absent.mapInPandas(empty, SCHEMA))
