"""Session settings every eventrail plan relies on."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

# JSON objects keep the last of duplicate keys; local times have no DST gaps; generated
# methods above HotSpot's compile limit would be interpreted, so they are split instead.
_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else built."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g"
) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventrail")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the call site of every column costs more than planning it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = "file://" + tempfile.mkdtemp(prefix="eventrail-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/eventrail/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished jobs that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
