"""Session helper for local runs; on a cluster the caller passes its own session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lumenrank") -> SparkSession:
    """A local session with UTC timestamps, AQE and Arrow on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``; in local mode, where that is unset, a new temporary one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lumenrank-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder for each application."""
    return f"{shared_folder(spark)}/lumenrank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written to the shared folder and read again: for rows that a plan needs several times, or that must not change."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of the Arrow batches that texts go to Python in.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut to ``BATCH_ROWS`` and ``BATCH_BYTES``, so that a worker's memory doesn't follow the partition's; smaller settings stay.

    Spark reads these settings when a plan runs, after this has returned, so they can't be put back here.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = conf.get(key)
        if not (held.lstrip("-").isdigit() and 0 < int(held) <= most):
            conf.set(key, str(most))
    return df


def local_path(path: str) -> str:
    """The plain path of a file: url, or the path as it is."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path
