"""The tenant dimension: loading and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import strip
from eventloom.model import PLANS, PROJECT, PROJECT_NAME_BOUNDS
from eventloom.operators.rejects import default_message, status_of
from eventloom.operators.validate import ERROR, failure


def check_projects(candidates: DataFrame) -> DataFrame:
    """Validate, default and trim candidate projects; adds `errors`.

    The name's length is checked before it is trimmed, so three blanks pass and
    are stored as an empty name; `empty_name` flags them.
    """
    low, high = PROJECT_NAME_BOUNDS
    size = F.length("name")
    name_rule = (
        F.when(F.col("name").isNull(), failure("body.name", "missing"))
        .when(size < low, failure("body.name", "string_too_short", f"String should have at least {low} characters"))
        .when(size > high, failure("body.name", "string_too_long", f"String should have at most {high} characters"))
    )
    plan_rule = F.when(
        ~F.col("plan").isin(PLANS),
        failure("body.plan", "enum", "Input should be 'free', 'pro' or 'enterprise'"),
    )
    return (
        candidates.withColumn(
            "errors", F.array_compact(F.array(name_rule.cast(ERROR), plan_rule.cast(ERROR)))
        )
        .withColumns({"name": strip(F.col("name")), "plan": F.coalesce("plan", F.lit(PLANS[0]))})
        .withColumn("empty_name", F.coalesce(F.col("name") == "", F.lit(False)))
    )


def judge_projects(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Add `code` (null = to be stored) to candidates.

    Names and ids are unique: the earliest candidate of an id wins, then of those
    the earliest of a name, and none does when the id or the name is taken already.
    Of equal rows one wins.  A clash is an unexpected error, as the service does
    not foresee it.
    """
    names = candidates.columns
    # Equal rows go on as one with their number, which combines before the shuffle.
    several = candidates.groupBy(*names).agg(F.count("*").alias("_copies"))
    checked = check_projects(several).withColumn("_bad", F.size("errors") > 0)
    # Ids are given by the service, so a repeated one is rare; the least row of an id is found without an order of all.
    row = F.struct("created_at", "name", "plan", "api_key")
    least = checked.groupBy("project_id", "_bad").agg(F.min(row).alias("_least"))
    least = least.withColumnsRenamed({"project_id": "_id", "_bad": "_is_bad"})
    taken = existing.groupBy("name").agg(F.lit(True).alias("_taken"))
    stored_ids = existing.groupBy("project_id").agg(F.lit(True).alias("_stored"))
    same = F.col("project_id").eqNullSafe(F.col("_id")) & (F.col("_bad") == F.col("_is_bad"))
    placed = checked.join(least, same, "left")
    looked_up = placed.join(taken, "name", "left").join(stored_ids, "project_id", "left")
    own_id = row.eqNullSafe(F.col("_least")) & F.col("_stored").isNull()
    earliest = F.struct("created_at", "project_id")
    usable = looked_up.where(~F.col("_bad") & own_id)
    first = usable.groupBy("name").agg(F.min(earliest).alias("_first"))
    judged = looked_up.join(first, "name", "left")
    clash = F.col("_taken").isNotNull() | ~own_id | (earliest != F.col("_first"))
    code = F.when(F.col("_bad"), "ValidationError").when(clash, "UnexpectedError")
    copies = judged.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    code = F.when((F.col("_nth") > 1) & ~F.col("_bad"), "UnexpectedError").otherwise(code)
    return copies.select(*names, "errors", "empty_name", code.alias("code"))


def new_projects(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("code").isNull()).select(*PROJECT.fieldNames())


def refused_projects(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("code").isNotNull()).select(
        "project_id",
        "name",
        "plan",
        "code",
        status_of(F.col("code")).alias("status"),
        default_message(F.col("code")).alias("message"),
        "errors",
    )


def project_by_key(projects: DataFrame, api_key: str) -> DataFrame:
    return projects.where(F.col("api_key") == api_key)


def project_by_id(projects: DataFrame, project_id: str) -> DataFrame:
    return projects.where(F.col("project_id") == project_id)
