"""What the training-data operators share: scratch tables in the cluster's shared folder, files, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java form of the word pattern of all contracts here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on the way to Python; a task's whole split of texts would otherwise be one, held in the JVM and in the worker.
BATCH_BYTES = 8 << 20


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Holds Arrow batches of what is run inside to BATCH_BYTES (one longer row comes alone); then the session's setting is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests), a temporary folder of this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lathe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lathe-scratch/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation. The result knows its path (scratch) and number of rows (n_rows), which the write counts."""
    path, seen = scratch_path(df.sparkSession, name), Observation()
    with short_batches(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch, out.n_rows = path, seen.get["rows"]
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that materialize() gave and that nothing reads any more."""
    delete(df.sparkSession, df.scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables. Frames that read them can't be used afterwards."""
    delete(spark, f"{shared_dir(spark)}/lathe-scratch")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text):
    """A-Z to a-z, all else as it is (lower() would change other scripts too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the strings of a column take about most_bytes at once (one longer text comes alone). At the end, what the worker held is given back: it stays alive for later tasks."""
    import numpy as np

    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if b.num_rows == 0:
            continue
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to
    b = col = ends = None  # noqa: F841
    pa.default_memory_pool().release_unused()


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI or plain path; works on executors for file, hdfs, s3 and gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class AtomicFile:
    """A file that appears under its name only when it is whole, so a retried or doubled task can't leave a torn one. As a context manager it goes if it wasn't committed."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.size, self.done = self.fs.open_output_stream(self.temp, compression=None), 0, False

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.temp, self.path)
        self.done = True
        return self.size

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, *_) -> None:
        if not self.done:
            self.out.close()
            self.fs.delete_file(self.temp)
