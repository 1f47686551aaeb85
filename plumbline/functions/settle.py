"""Written intermediate tables: computed once, read by all that follow."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the session's JVM ends.

    Where that is unset, a temporary folder will do for a local master, as driver and executors are one process; on a
    cluster each executor would write to its own disk, so there it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    folder = f"{base.rstrip('/')}/plumbline/{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a written table that nothing reads any more."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` into the shared folder and read it back.

    For facts that are far smaller than what they come from and are used more than once: the source is scanned once, and a
    lost executor costs no more than the tasks it was running."""
    path = f"{shared(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
