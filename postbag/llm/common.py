"""Shared helpers: reading tables, written intermediate tables, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_FALLBACK: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`).

    Only where it is unset and the master is local, as in tests, is a temporary folder
    made; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="postbag-")
    return _FALLBACK[app]


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/postbag-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this application has written; frames read from them end with it."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not share the driver's path."""
    on_path = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if any(p and os.path.realpath(p) == os.path.realpath(_ROOT) for p in on_path):
        return
    app = spark.sparkContext.applicationId
    if _FALLBACK.get(f"zip-{app}"):
        return
    folder = tempfile.mkdtemp(prefix="postbag-zip-")
    archive = os.path.join(folder, "postbag_modules.zip")
    with zipfile.ZipFile(archive, "w") as z:
        top = os.path.join(_ROOT, "postbag")
        for where, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(where, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(archive)
    _FALLBACK[f"zip-{app}"] = archive


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(column)
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        lo = 0
        for hi in [*edges.tolist(), batch.num_rows]:
            yield batch.slice(lo, hi - lo)
            lo = hi


def doc_ids_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
