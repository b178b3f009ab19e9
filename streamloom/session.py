"""Session and lineage helpers."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "streamloom", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STREAMLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


_own: dict[str, str] = {}  # folders of our own, by application


def _folder(spark: SparkSession) -> str:
    """This application's folder for kept tables, in the shared folder that the session names in
    ``spark.checkpoint.dir`` or that was set for the context. Without either, on one machine as in tests, a
    temporary one; on a cluster that is an error, as no folder is known to be shared."""
    context = spark.sparkContext
    if context.applicationId not in _own:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if shared is None and context.master.startswith("local"):
            import tempfile

            shared = tempfile.mkdtemp(prefix="streamloom-")
        if shared is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            atexit.register(_at_exit)
        _own[context.applicationId] = f"{shared.rstrip('/')}/streamloom-{context.applicationId}"
    return _own[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written once as a table in the shared folder and read from there, so that
    it is not computed again for each use or after the loss of an executor."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the kept tables of this application. Results that were not written yet can't be used any more."""
    path = _own.pop(spark.sparkContext.applicationId, None)
    if path:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
