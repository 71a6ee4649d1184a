"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def long_texts(spark: SparkSession) -> None:
    """Bound the batches that go to the Python workers by their bytes; Spark's default counts rows only, for narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, scripts) gets a scratch folder when the
    setting is absent; on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder (not yet made) below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_shared(path: str):
    """(filesystem, path) of pyarrow for a shared path, with or without a scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def texts_of(column: pa.Array, piece: int = 512) -> Iterator[list[str]]:
    """The texts of an Arrow column in short lists, null as empty text."""
    for i in range(0, len(column), piece):
        in_worker()
        yield [t or "" for t in column.slice(i, piece).to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Janitor:
    """Frees what a Python worker keeps once its job is over.

    Workers outlive their tasks, and the memory they hold is missing to the stages that follow.
    Arrow takes its buffers from the system's allocator, which is told to give large ones back at
    once, and a thread drops kept objects ``IDLE_SECONDS`` after the last use.
    """

    IDLE_SECONDS = 2.0
    #: Fixed value: number of the allocator's option for the least size of a block of its own.
    MMAP_THRESHOLD = -3

    def __init__(self):
        import ctypes
        import threading

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(self.MMAP_THRESHOLD, 2 << 20)
        except (AttributeError, OSError):  # another C library
            pass
        self.kept: dict = {}
        self.used, self.busy = 0.0, threading.Event()
        threading.Thread(target=self.watch, daemon=True).start()

    def touch(self) -> None:
        import time

        self.used = time.monotonic()
        self.busy.set()

    def watch(self) -> None:
        import ctypes
        import gc
        import time

        while True:
            self.busy.wait()
            while time.monotonic() - self.used < self.IDLE_SECONDS:
                time.sleep(0.5)
            self.busy.clear()
            self.kept.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass


def in_worker() -> Janitor:
    """The janitor of this Python worker; every task function calls this as it works."""
    import sys

    janitor = sys.__dict__.get("_llm_janitor")
    if janitor is None:
        janitor = sys.__dict__["_llm_janitor"] = Janitor()
    janitor.touch()
    return janitor


def per_worker(kind: str, name: str, make):
    """What ``make()`` gives, kept by a Python worker for its next tasks until it idles or anything else is asked for."""
    kept = in_worker().kept
    found = kept.get((kind, name))
    if found is None:
        kept.clear()
        found = kept[kind, name] = make()
    return found


def quiet_threads() -> None:
    """One thread per task: Spark already fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
