"""What the operators share: the folder that all machines see, written tables, Arrow batch sizes, let-bindings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_run = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none (a local test) is a temporary folder made, and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.applicationId not in _own_dirs:
            own = tempfile.mkdtemp(prefix="strandline-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own_dirs[spark.sparkContext.applicationId] = own
        base = _own_dirs[spark.sparkContext.applicationId]
    return f"{base.rstrip('/')}/strandline-{_run}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_quiet_remove, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001  the session has ended already; its folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage, and survives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # files of a finished shuffle go as soon as the write is over
    keep = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", keep)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    remove_path(df.sparkSession, df._strandline_path)  # type: ignore[attr-defined]


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound the Arrow batches sent to Python: long texts make row counts alone a poor bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def hand_back() -> None:
    """At the end of a Python task: give what it has freed to the system. Workers stay for further tasks, and with them
    what their allocators keep; an executor's memory holds all of them beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once per row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_known(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) after df's columns are computed. Catalyst would push the filter below them and compute there,
    again, all that the condition needs; a column that isn't deterministic keeps it above."""
    mark = "__strandline_fence"
    return df.withColumn(mark, F.rand(0)).where(condition & (F.col(mark) >= 0)).drop(mark)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no further column of the input can clash with what an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))
