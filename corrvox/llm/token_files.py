"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames. Every frame but the last holds the ids of some whole
documents, little-endian, 16 bits each where the vocabulary allows it, else 32. The last frame is
the file's index: for each document its identifier, frame, place in the frame and number of ids.
A skippable frame ends the file (the public seekable zstandard layout): for each frame its packed
size, its plain size and the low 32 bits of its plain bytes' XXH64, then the number of frames, a
descriptor byte and a magic number. Readers fetch the tail, the index and the frames that they
need; each frame is checked against its checksum.

Documents are written in ascending order of identifier. Sampled splitters range-partition the
rows by (identifier, first characters and hash of the text), each partition is one file, and the running totals of the partitions
(one row each) give every document's start. A task writes under a temporary name and renames, so
a retry leaves the same file. Null text counts as empty and has the end id alone.
Strings of special tokens in a text give their ids, as the library's defaults say (see ``tokens``). Null identifiers
come first. Repeated identifiers keep a place each, in
order of the text's first 64 characters. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrvox.llm.common import materialize, new_path, partitions
from corrvox.llm.tokens import chunks, encoder

# Fixed values of the public seekable zstandard layout.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


class FrameWriter:
    """Writes documents to an open file object; ``frame_ids`` ids to a frame at least, whole documents only."""

    def __init__(self, out, wide: bool, frame_ids: int = 1 << 18, level: int = 3) -> None:
        import zstandard

        self.out, self.dtype, self.frame_ids = out, np.dtype("<u4" if wide else "<u2"), frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []
        self.held: list[bytes] = []
        self.n = self.total = 0

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.table.append((len(packed), len(data), _xxh(data)))
        self.out.write(packed)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Documents in order: their identifiers, which are null, their ids one after the other, where each begins and the end."""
        ids = np.ascontiguousarray(ids, self.dtype)
        a, n_docs = 0, len(starts) - 1
        while a < n_docs:
            # As many documents as fill the frame: the one that takes it to ``frame_ids`` is its last.
            z = min(n_docs, int(np.searchsorted(starts, starts[a] + self.frame_ids - self.n)))
            z = max(z, a + 1)
            rows = np.zeros(z - a, _INDEX)
            rows["doc_id"], rows["null"], rows["frame"] = np.where(null[a:z], 0, doc_ids[a:z]), null[a:z], len(self.table)
            rows["at"], rows["n"] = self.n + starts[a:z] - starts[a], starts[a + 1 : z + 1] - starts[a:z]
            self.index.append(rows)
            self.held.append(ids[starts[a] : starts[z]].tobytes())
            self.n += int(starts[z] - starts[a])
            self.total += int(starts[z] - starts[a])
            if self.n >= self.frame_ids:
                self.flush()
            a = z

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.n = [], 0

    def close(self) -> int:
        self.flush()
        rows = np.concatenate([np.zeros(0, _INDEX), *self.index])
        self._frame(struct.pack("<BQ", self.dtype.itemsize, len(rows)) + rows.tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return sum(x[0] for x in self.table) + 8 + len(body)


class FrameReader:
    """Random access to a token file (anything with seek, read and a size)."""

    def __init__(self, f, size: int) -> None:
        self.f = f
        f.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file: the seek table is missing")
        f.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        width, count = struct.unpack("<BQ", index[:9])
        self.dtype = np.dtype(f"<u{width}")
        self.index = np.frombuffer(index[9:], _INDEX, count)
        self._last: tuple[int, np.ndarray] | None = None

    def frame(self, k: int) -> bytes:
        import zstandard

        self.f.seek(int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.table[k, 0])))
        if len(data) != self.table[k, 1] or _xxh(data) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, row) -> np.ndarray:
        k = int(row["frame"])
        if self._last is None or self._last[0] != k:
            self._last = (k, np.frombuffer(self.frame(k), self.dtype))
        return self._last[1][int(row["at"]) : int(row["at"]) + int(row["n"])]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents of that identifier; decompresses their frames only."""
        return [self.ids(r) for r in self.index[(self.index["doc_id"] == doc_id) & (self.index["null"] == 0)]]


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", wide: bool = False, drops_spaces: bool = False, frame_ids: int = 1 << 18, parts: int | None = None) -> DataFrame:
    """Encode and write every row of ``docs``; returns the manifest (MANIFEST), a row for each file."""
    spark = docs.sparkSession
    out_dir = out_dir or new_path(spark, "tokens")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("head", F.substring("text", 1, 64))
        .repartitionByRange(parts or partitions(spark), "doc_id", "head", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "head", F.xxhash64("text"), "text")
        .drop("head")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, sink = TaskContext.get().partitionId(), encoder(tokenizer, drops_spaces), None
        n = 0
        for b in batches:
            if sink is None and b.num_rows:
                fs, base = _open(out_dir)
                fs.create_dir(base, recursive=True)
                name = f"{base}/part-{part:06d}.ids.zst"
                tmp = f"{base}/_{part:06d}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(tmp)
                writer = FrameWriter(sink, wide, frame_ids)
            texts, null = b.column("text"), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = b.column("doc_id").fill_null(0).to_numpy()
            for a, z in chunks(texts):
                writer.add(doc_ids[a:z], null[a:z], *enc.column(texts.slice(a, z - a)))
            n += b.num_rows
        if sink is not None:
            size = writer.close()
            sink.close()
            fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{out_dir}/part-{part:06d}.ids.zst"], "n_docs": [n], "n_ids": [writer.total], "n_bytes": [size]})

    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (binary, 32 bits each)."""
    files = manifest.select("part", "file", "n_ids", "n_bytes").orderBy("part").collect()  # a row for each file
    base, total = {}, 0
    for r in files:
        base[r["part"]], total = total, total + r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = _open(row["file"])
                with fs.open_input_file(path) as f:
                    r = FrameReader(f, row["n_bytes"])
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(r.index["frame"].astype(np.int64))) + 1, [len(r.index)]])
                    for k, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        rows = r.index[k:z]
                        whole = np.frombuffer(r.frame(int(rows["frame"][0])), r.dtype).astype("<u4")
                        raw = [whole[x:y] for x, y in zip(rows["at"].tolist(), (rows["at"] + rows["n"]).tolist(), strict=True)]
                        starts = row["first"] + np.concatenate([[0], np.cumsum(rows["n"][:-1])]).astype(np.int64)
                        row["first"] += int(rows["n"].sum())
                        cols = {"doc_id": pa.array(rows["doc_id"].astype(np.int64), mask=rows["null"] != 0), "start": pa.array(starts), "n_tokens": pa.array(rows["n"].astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())}
                        yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array([x.tobytes() for x in raw], pa.binary())} if with_ids else {}))

    todo = spark.createDataFrame([(r["file"], r["n_bytes"], base[r["part"]]) for r in files], "file string, n_bytes long, first long")
    return todo.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
