"""What the operators share: the text column, and tables written to cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: ASCII white space that parts words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go when the query that made them ends; its written rows are what later ones read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def whole_text(name: str = "text") -> Column:
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_KEPT: dict = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """What one worker keeps for later tasks, of one operator at a time: tasks of another one free it."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


#: Of the C library, where it has it: gives free memory back to the system.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives memory that is free but still held back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def forget() -> None:
    """Frees what this worker keeps, and what earlier tasks freed; called by tasks that need the memory for texts."""
    _KEPT.clear()
    trim()


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back from there.

    It cuts lineage: an executor lost later costs no recomputation. The files go when the application ends, or
    by dropped().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    trim()
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for table in tables:
        at, files = _files(table.sparkSession, table.written_path)
        files.delete(at, True)
