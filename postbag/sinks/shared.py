"""Folders that driver and executors share, and files of rows written by tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under `spark.checkpoint.dir`; where that is unset, on a local master only, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="postbag-files-")
        top = _FALLBACK[app]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: lineage ends here."""
    path = shared_folder(df.sparkSession, f"postbag-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, path: str) -> int:
    place, fs = _place(spark, path)
    return fs.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def move_parts(spark: SparkSession, source: str, target: str, first: int) -> None:
    """Move the part files of folders under `source` to the same folders under `target`, numbered from `first` on."""
    place, fs = _place(spark, source)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(place):
        if not folder.isDirectory():
            continue
        to = path(path(target), folder.getPath().getName())
        fs.mkdirs(to)
        for f in fs.listStatus(folder.getPath()):
            part, number, rest = f.getPath().getName().split("-", 2)
            if not fs.rename(f.getPath(), path(to, f"{part}-{int(number) + first:05d}-{rest}")):
                raise OSError(f"{f.getPath()} was not moved to {to}")


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_files(rows: DataFrame, folder: str) -> None:
    """One file per (name, content) row under a mounted folder that all executors share.

    Each is written beside its place and then moved there, so a task that is run again
    leaves whole files.
    """
    place = folder.removeprefix("file://")

    def run(part: Iterator[Row]) -> None:
        os.makedirs(place, exist_ok=True)
        for r in part:
            data = r.content.encode() if isinstance(r.content, str) else bytes(r.content)
            beside = os.path.join(place, f".{r.name}-{uuid.uuid4().hex}")
            with open(beside, "wb") as f:
                f.write(data)
            os.replace(beside, os.path.join(place, r.name))

    rows.select("name", "content").foreachPartition(run)
