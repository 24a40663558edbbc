"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "seriata", cpus: str = "*") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    threads = os.cpu_count() or 8
    partitions = threads if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    A temporary folder is made only for a local master with nothing set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="seriata-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder name below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/seriata/{uuid.uuid4().hex}"


def settle(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in a folder for each value of ``by``, and go on from the written rows.

    Runs a job.  Used where later steps must all see the same partition
    numbers, whatever executors are lost in between; unlike a checkpoint the
    table can be read by column.
    """
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
