"""Spark session for local work, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "palimpsest", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("PALIMPSEST_SHARED_FOLDER") or tempfile.mkdtemp(prefix="palimpsest-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, which only a local session can share between its
    executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        global _local_folder
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="palimpsest-")
        folder = _local_folder
    return folder


_local_folder: str | None = None


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder below the shared one."""
    return f"{shared_folder(spark)}/palimpsest-{uuid.uuid4().hex}"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches() -> None:
    """From now on the session in use sends rows to Python in batches of about 4 MB, unless it was told a size.

    Long texts and word lists then take no more of a worker's memory, however many rows a task has.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    The rows are computed once, survive the loss of executors, and come back with known sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
