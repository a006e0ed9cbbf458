"""Helpers shared by the training-data operators: shared folders, files on them, and per-batch runners."""

from __future__ import annotations

import ctypes
import io
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"
BATCH_BYTES = 8 << 20
#: Stands for a null id in Python and in files: pandas would turn ids beside a null into floats.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where both are one process,
    is there a default; on a cluster an unset folder is an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{LOCAL_DEFAULT}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, what: DataFrame | str) -> None:
    """Delete a folder, or what a table of materialize() that no plan needs any more was written to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [what] if isinstance(what, str) else {f.rpartition("/")[0] for f in what.inputFiles()}
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _fs(path: str):
    """(pyarrow filesystem or None for local, path)."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return None, u.path or path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> int:
    """Write whole, then rename: a task that is lost or run twice leaves no half file under the final name."""
    fs, p = _fs(path)
    tmp = f"{p}.{uuid.uuid4().hex}.tmp"
    if fs is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, p)
    else:
        fs.create_dir(os.path.dirname(p), recursive=True)
        with fs.open_output_stream(tmp) as f:
            f.write(data)
        fs.move(tmp, p)
    return len(data)


class AtomicFile(io.RawIOBase):
    """A binary file written beside its final name and renamed on commit()."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        if self.fs is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.f = open(self.tmp, "wb")
        else:
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.f = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def writable(self):
        return True

    def write(self, b):
        self.f.write(b)
        self.size += len(b)
        return len(b)

    def tell(self):
        return self.size

    def commit(self):
        self.f.close()
        if self.fs is None:
            os.replace(self.tmp, self.path)
        else:
            self.fs.move(self.tmp, self.path)


def open_range(path: str):
    """A seekable binary reader."""
    fs, p = _fs(path)
    return open(p, "rb") if fs is None else fs.open_input_file(p)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = BATCH_BYTES) -> None:
    """Whole texts go to Python in Arrow batches of so many rows and bytes at most, so that a worker's memory stays
    bounded. The session keeps the lower setting: it is read when a plan runs, after the operator has returned."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system: an idle worker keeps it otherwise, beside the JVM's next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its freed memory back when its partition is done."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


_CACHES: list = []


def keep_only(*caches) -> None:
    """Empty what other operators have cached in this worker process: workers are used again, and only one operator's
    tables should take memory at a time."""
    for c in _CACHES:
        if not any(c is x for x in caches):
            c.clear()
    _CACHES[:] = caches
