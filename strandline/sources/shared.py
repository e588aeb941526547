"""Tables written between the rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="strandline-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read back: the lineage ends here, and a lost executor takes nothing along."""
    path = f"{shared_dir(df.sparkSession)}/strandline-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_drop, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandline_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    _drop(df.sparkSession, df._strandline_path)  # type: ignore[attr-defined]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone
        pass
