"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: set[Written] = set()


def folder(spark: SparkSession) -> str:
    """A new folder's name below the session's spark.checkpoint.dir; only without one, on a local master (tests), below a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="scratch-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        at = _own[app]
    return f"{at}/scratch-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


class Written:
    """A frame written as a table, so that a lost executor costs no more than the step at hand; drop() removes it, or else the program's end."""

    def __init__(self, df: DataFrame):
        self._spark, self._at = df.sparkSession, folder(df.sparkSession)
        df.write.parquet(self._at)
        self.df = self._spark.read.schema(df.schema).parquet(self._at)

        _written.add(self)

    def drop(self) -> None:
        _written.discard(self)
        drop(self._spark, self._at)


@atexit.register
def _forget() -> None:
    """Remove what no one has dropped, if the session can still do so."""
    for x in list(_written):
        try:
            x.drop()
        except Exception:  # noqa: BLE001  the session may be gone with all that it could reach
            pass
