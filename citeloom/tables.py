"""Intermediate tables: what several steps use is written once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of a query as soon as that ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few short columns that are few enough to be sent to all tasks.
BROADCAST_ROWS = 500_000
#: The places of the tables written in the innermost block of ``last_stays``.
_WRITTEN: ContextVar[list | None] = ContextVar("written", default=None)


def workspace(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, in sessions on one machine, a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="citeloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


@contextmanager
def last_stays() -> Iterator[None]:
    """Of the tables written in the block only the last stays, which was made from the others: those are removed at its end,
    not when the application ends, or once the caller lets go of their DataFrames. A table that is read after the block as
    part of another's plan has to be the last, or lasting."""
    outer, written = _WRITTEN.get(), []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for held, place, files in written[:-1]:
            if held() is None:
                files.delete(place, True)
            else:
                weakref.finalize(held(), files.delete, place, True).atexit = False
        if outer is not None:
            outer += written[-1:]


def kept(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written as a table and read again: it is worked out once, lineage and plan end there, and a lost executor
    costs only the tasks that read it. The exchanges of the write are removed with it, the table when the application ends or,
    unless it is ``lasting``, by ``last_stays``."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    if not lasting and _WRITTEN.get() is not None:
        _WRITTEN.get().append((weakref.ref(table), place, files))
    return table



def measured(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows, sent to all tasks by joins where it is counted to be small."""
    return F.broadcast(table) if table.count() <= rows else table


def dealt(table: DataFrame) -> DataFrame:
    """Rows with nested columns, which joins deal out and never send whole to the driver: Spark judges a table by its
    compressed files, of which such rows are many times the size once they are read."""
    return table.hint("merge")
