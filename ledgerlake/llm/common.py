"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or f"file://{_own_folder()}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/ledgerlake-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: later jobs don't compute it anew, and lost executors don't take it along."""
    at = new_folder(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@cache
def _trim() -> Callable[[int], int]:
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which returns what it has freed to the system when its task ends: Python workers live on and would hold it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


def map_arrow(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """df through a function of record batches. make() runs once a task and gives that function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(giving_back(run), schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's whole texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names don't matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value's decimal text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def local_path(uri: str) -> str | None:
    """The path of a file: URI; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def store(uri: str):
    """(pyarrow file system, path) for a URI or path that executors share."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit integers (the finaliser of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_threads() -> None:
    """One thread for each task: Spark gives tasks to cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
