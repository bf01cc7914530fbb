"""Shared working folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_OPTION = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local master, where driver and executors share a disk, may go without:
    it gets a temporary folder for the life of the session.
    """
    folder = spark.conf.get(FOLDER_OPTION, None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {FOLDER_OPTION} to a folder all executors can reach")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nothing has been written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read back: what follows neither repeats nor loses its work."""
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
