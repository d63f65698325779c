"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder where that is unset and driver and executors are one process (tests).

    On a cluster a folder of one machine would lose what other machines write, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/tessera-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends, or by discard()."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(discard_all)
    _made[path] = spark
    return path


@contextmanager
def without_leftovers(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with without_leftovers(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._tessera_path = path
    return found


def discard(*tables: DataFrame | str) -> None:
    """Removes materialized tables (or scratch paths) that nothing reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_tessera_path", None)
        spark = _made.pop(path, None)
        if spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard_all() -> None:
    for path in list(_made):
        try:
            discard(path)
        except Exception:  # the session may be gone
            return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives free memory back when its task ends: workers outlive their tasks."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner
