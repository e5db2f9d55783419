"""Helpers shared by the corpus operators: written cut points, sizes and session settings."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is measured to hold at most so many rows, and so many bytes in its texts and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Rows in an Arrow batch of whole texts: Spark's 10,000 are 50 MB and more on both sides of the pipe for each task.
TEXT_ROWS = 500
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs in one process (tests on one machine) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corrvox-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corrvox-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Batches that go to Python have ``most`` rows at most (None, or a session that has fewer: as the session says)."""
    was = int(spark.conf.get(_ARROW_ROWS))
    if most is None or 0 < was <= most:
        yield
        return
    spark.conf.set(_ARROW_ROWS, most)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, was)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors. ``batch_rows``: see ``arrow_rows``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with arrow_rows(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def release(df: DataFrame) -> None:
    """Delete the written table behind ``df`` (one made by ``materialize``) when no plan reads it any more."""
    files = df.inputFiles()
    for spark, path in list(_written):
        if files and any(path.rsplit("/", 1)[-1] in f for f in files):
            delete_path(spark, path)
            _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder's own retention then applies
            return


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``most_bytes`` bytes in columns of no fixed width; reads ``most`` + 1 rows at most."""
    sized = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")).cast("long"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary") or f.dataType.simpleString().startswith("array")]
    r = df.select(sum(sized, F.lit(0).cast("long")).alias("bytes")).limit(most + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return r["rows"] <= most and r["bytes"] <= most_bytes


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``right`` only if it is measured to be small, else shuffle."""
    return left.join(F.broadcast(right) if small(right, most) else right.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
