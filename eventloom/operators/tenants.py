"""Tenants: key lookup, referential checks and removal.

No join here forces a broadcast.  Spark broadcasts the project side when its
known or measured size is under `spark.sql.autoBroadcastJoinThreshold`; past
that it sorts and merges, and splits a tenant (or the null key) that holds an
outsized share of the rows, because nothing after these joins needs their
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.settings import Settings


def key_problem(api_key: Column, settings: Settings) -> Column:
    """Message of a key refused by its form alone, else null."""
    return F.when(F.coalesce(api_key, F.lit("")) == "", "Missing API Key").when(
        ~api_key.startswith(settings.key_prefix), "Bad API Key"
    )


def keyring(projects: DataFrame) -> DataFrame:
    """One project per key; the oldest wins should a key repeat."""
    row = F.struct("created_at", "project_id", "plan")
    return (
        projects.where(F.col("api_key").isNotNull())
        .groupBy("api_key")
        .agg(F.min(row).alias("_row"))
        .select(
            F.col("api_key").alias("_key"),
            F.col("_row.project_id").alias("project_id"),
            F.col("_row.plan").alias("plan"),
        )
    )


def resolve_tenants(requests: DataFrame, projects: DataFrame, settings: Settings) -> DataFrame:
    """Add `project_id`, `plan` and, for refused keys, `tenant_code` / `tenant_message`."""
    problem = key_problem(F.col("api_key"), settings)
    looked_up = F.when(problem.isNull(), F.col("api_key"))
    joined = requests.join(keyring(projects), looked_up == F.col("_key"), "left").drop("_key")
    unknown = F.col("project_id").isNull()
    return joined.withColumns(
        {
            "tenant_code": F.when(problem.isNotNull(), "UnauthorizedError").when(
                unknown, "NotFoundError"
            ),
            "tenant_message": F.coalesce(
                problem,
                F.when(
                    unknown,
                    F.concat(F.lit("Project by api_key "), F.col("api_key"), F.lit(" not Found")),
                ),
            ),
        }
    )


def with_known_project(events: DataFrame, projects: DataFrame) -> DataFrame:
    return events.join(projects.select("project_id"), "project_id", "left_semi")


def orphans(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events whose project does not exist."""
    return events.join(projects.select("project_id"), "project_id", "left_anti")


def without_projects(events: DataFrame, removed: DataFrame) -> DataFrame:
    """What remains after projects are removed together with their events."""
    return events.join(removed.select("project_id"), "project_id", "left_anti")
