"""Shared work folders, written tables and files that survive the loss of an executor.

Everything lies below ``spark.checkpoint.dir``; where a session in local mode has none (tests), one below the
temporary folder is set.  Files are opened through ``pyarrow.fs``, so local, HDFS and S3 places work alike.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Where each table of ``written`` lies.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI; it isn't made yet."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:
        base = ("file://" if base.startswith("/") else "") + base
    return f"{base.rstrip('/')}/fathom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table on shared storage: it is computed once, and later steps don't depend on executors' disks."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of ``written`` that nothing reads any more; others stay as they are."""
    for table in tables:
        path = None if table is None else _PLACES.pop(table, None)
        if path:
            fs, place = filesystem(path)
            fs.delete_dir(place)


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tidied(run: Callable, tokens: bool = False) -> Callable:
    """run for mapInArrow, in a Python worker that keeps little: workers stay alive between tasks and stages.

    Without tokens the pieces that a tokenizer's earlier tasks have kept are forgotten first; with them Python doesn't
    look for cycles among its many small objects, as encoding makes none.  At the end, also of a task that fails, unused
    memory goes back to the system.
    """

    def then_tidy(batches):
        import pyarrow as pa

        held = sys.modules.get("fathom.llm.tokens")
        if held and not tokens:
            held.forget()
        if tokens:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()
            _trim()

    return then_tidy


def _trim() -> None:
    """Gives the C library's free memory back, where it can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
