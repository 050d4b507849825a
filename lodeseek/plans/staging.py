"""Tables written to the shared folder of the cluster, to cut lineage and to be read more than once.

The folder is the one that the session names in ``spark.checkpoint.dir``. Every executor and the driver
reach it, so a staged table survives the loss of any executor. Only a local session may go without that
setting; it then gets a temporary folder of its own, because there is one machine only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_staged: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {_SETTING} to a folder that all executors reach")
    found = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
    spark.conf.set(_SETTING, found)
    return found


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/lodeseek/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_leave)
    _staged.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(df.sparkSession, path)
        _staged.discard(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner take away the shuffle files of plans that nothing refers to any more; it acts when the driver collects garbage."""
    spark.sparkContext._jvm.java.lang.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _leave() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_staged):
        try:
            _delete(spark, path)
        except Exception:  # the session may be closing; what is left lies in the shared folder only
            return
