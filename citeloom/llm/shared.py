"""Helpers of the training-data operators: shared tables, input columns, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nothing larger than this is ever broadcast; every broadcast here is measured first.
BROADCAST_BYTES = 64 << 20

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE = " \t\n\x0b\x0c\r"


def workspace(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and the session runs on one machine (tests), a temporary folder is made and used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there,
    and a lost executor costs only the tasks that read the table next. The table is removed
    when the application ends."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose memory goes back to the machine when a task ends: Spark keeps
    its Python workers for later stages, which would add theirs to what the allocators hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # other C libraries have no such call
                pass

    return task


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs meanwhile sends Python Arrow batches of about ``size`` bytes at most: a batch by rows alone can be tens of
    MB of texts, which the executor's JVM and the worker hold at once for each task."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def with_columns(schema_of: DataFrame, new: str, dropped: Iterable[str] = ()) -> str:
    """DDL of a frame's columns (less those that ``new`` names again, and ``dropped``) and ``new``."""
    fresh = [part.strip().split(" ", 1)[0] for part in new.split(",")]
    gone = {*fresh, *dropped}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of.schema if f.name not in gone]
    return ", ".join([*kept, new])


def put(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with the columns set; those that it has already by such a name go."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in names]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + arrays, names=[batch.schema.names[i] for i in kept] + names
    )


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space. Every run becomes one
    mark and the marks are counted, so no array of words is made."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(F.btrim(text, F.lit(SPACE)) == "", F.lit(0)).otherwise(F.length(marks)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
