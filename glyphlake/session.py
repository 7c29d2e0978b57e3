"""Session construction for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int | None = None, partitions: int = 8, app: str = "glyphlake") -> SparkSession:
    """A local session with adaptive execution, for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GLYPHLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables as a DataFrame, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or in local mode a new temporary one where that is unset."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        import tempfile

        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphlake-checkpoint-"))
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder that is not there yet, where driver and executors share what is written."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/glyphlake/{tag}-{uuid.uuid4().hex}"


def checkpointed(df):
    """df.checkpoint() in the folder that driver and executors share."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
