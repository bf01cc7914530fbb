"""The stored project dimension, and removing projects together with their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.model import EVENT_COLUMNS, PROJECT
from eventloom.operators.projects import judge_projects, new_projects
from eventloom.operators.tenants import without_projects
from eventloom.sources.folders import Folders
from eventloom.sources.store import ID_FILTER, SLOT, STORED, evenly, existing_table, read_events, replace_batch

_PROJECTS = T.StructType([*PROJECT.fields, T.StructField("batch_id", T.LongType())])
_PART = ["batch_id", *SLOT]
_AFFECTED = T.StructType([field for field in STORED.fields if field.name in _PART])


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    stored = existing_table(spark, path, _PROJECTS)
    return spark.createDataFrame([], _PROJECTS) if stored is None else stored


def load_projects(candidates: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Judge candidates against what is stored, store the new ones, and return all with their `code`.

    A batch replaces its own folder, so a repeated load stores the same projects.
    """
    stored = read_projects(candidates.sparkSession, path).where(F.col("batch_id") != batch_id)
    judged = judge_projects(candidates, stored)
    replace_batch(new_projects(judged), path, batch_id)
    return judged


def remove_projects(removed: DataFrame, path: str, staging: str) -> None:
    """Rewrite the parts of the event store that hold events of the removed projects, without these.

    A part is a day of a slot of a batch.  What stays of such parts is written to
    `staging` first, and then over them in one job, whatever their number; parts of
    which nothing stays are removed.  Others are not touched.  A run that broke off
    is finished by calling it again with the same `staging`, which must be empty or
    new otherwise.
    """
    spark, path = removed.sparkSession, path.rstrip("/")
    affected = existing_table(spark, f"{staging}/affected", _AFFECTED)
    if affected is None:
        events = read_events(spark, path)
        gone = removed.select("project_id").distinct()
        found = events.join(gone, "project_id", "left_semi").select(*_PART).distinct()
        kept = without_projects(events.join(found, _PART, "left_semi"), gone)
        kept.select(*EVENT_COLUMNS, *_PART).write.mode("overwrite").partitionBy(*_PART).parquet(f"{staging}/kept")
        found.write.parquet(f"{staging}/affected")
        affected = spark.read.schema(_AFFECTED).parquet(f"{staging}/affected")
    kept = existing_table(spark, f"{staging}/kept", STORED).select(*EVENT_COLUMNS, *_PART)
    writer = evenly(kept, _PART, ["project_id", "timestamp"], ID_FILTER)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    # names of folders only; no event passes the driver
    emptied = affected.join(kept.select(*_PART).distinct(), _PART, "left_anti")
    folders = Folders(spark)
    for part in emptied.toLocalIterator():
        folders.delete(f"{path}/" + "/".join(f"{name}={part[name]}" for name in _PART))
