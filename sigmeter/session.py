"""Session defaults and the shared folder used for materialised intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sigmeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder: on a cluster that would not be visible to executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        active = spark.sparkContext.getCheckpointDir()
        named = active if active else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and fixes the statistics."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all cores by near-unique keys, before work that multiplies them.

    The number is explicit: without one, adaptive execution would merge a small table back into one task.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Rows go to Python workers in Arrow batches of about ``most`` bytes, from here on in this session.

    Set before texts are sent: 10,000 of them at once take some hundred MB beside an executor's heap and
    as much again in its workers. Results never depend on how rows are batched.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package; once per Spark context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_sigmeter_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sigmeter.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sigmeter", os.path.relpath(full, root)))
    sc.addPyFile(target)  # served by the driver, so any local folder will do
    sc._sigmeter_shipped = True
