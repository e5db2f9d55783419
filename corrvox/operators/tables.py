"""Written cut points: tables under the session's shared folder, removed when the program ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where all is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corrvox-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(spark: SparkSession, path: str) -> str:
    """Have ``path`` removed when the program ends."""
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelves:
    """Rows dealt by a whole number ``by`` below ``path`` and read back one number at a time: a loop that passes each number once
    reads each row once."""

    def __init__(self, spark: SparkSession, path: str, by: str, schema: str) -> None:
        self.spark, self.path, self.by, self.schema = spark, path, by, schema

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(self.by).parquet(self.path)

    def get(self, *numbers: int) -> DataFrame:
        """Rows of these numbers; all rows without one."""
        wanted = [f"{self.path}/{self.by}={k}" for k in numbers] or [self.path]
        there = [p for p in wanted if exists(self.spark, p)]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*there)


def new_folder(spark: SparkSession) -> str:
    return written(spark, f"{shared_dir(spark)}/corrvox-{uuid.uuid4().hex}")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(rows: DataFrame) -> DataFrame:
    """Few bytes that much is made of, dealt over as many tasks as a shuffle has: a small file would be one task."""
    return rows.repartition(shuffles(rows.sparkSession), *rows.columns[:1])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder's own retention then applies
            return
