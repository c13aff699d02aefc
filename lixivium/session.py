"""Session, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lixivium", cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a local folder only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lixivium-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_MADE: list[str] = []  # folders of this process below the shared one


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted by release or when the process ends."""
    if not _MADE:
        atexit.register(_at_exit, spark)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what stage and new_path made: results that still read it must have been consumed or written."""
    if spark.sparkContext._jsc is None:  # stopped: nothing can be deleted any more
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended in any way
        release(spark)


def stage(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later branches neither recompute nor depend on an executor."""
    path = new_path(spark, f"stage-{name}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
