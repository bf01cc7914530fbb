"""Tunable limits and the session options the engine relies on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Service limits. The defaults are the production values."""

    environment: str = "dev"

    # Acceptance window of an event's own time, relative to its receipt.
    max_future_minutes: int = 5
    max_age_days: int = 30

    # Valid events allowed in one batch request.
    min_batch: int = 1
    max_batch: int = 500

    # Requests per quota window.
    quota_enabled: bool = False
    quota_window_seconds: int = 60
    quota_free: int = 100
    quota_pro: int = 1_000
    quota_enterprise: int = 10_000
    quota_anonymous: int = 10
    quota_project_create: int = 5

    # Files a streaming read takes per micro-batch.
    files_per_trigger: int = 100

    @property
    def key_prefix(self) -> str:
        return f"wk_{self.environment}"


# Options that results or plans depend on, set on whatever session is handed in.
SESSION_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value, in objects and in merged maps.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A deep LIMIT/OFFSET page is sorted on the cluster, not in the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # The validation stages are wide but simple, so let them be generated as one;
    # where the code gets too long for the JIT compiler, split it instead.
    "spark.sql.codegen.maxFields": "300",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SESSION_OPTIONS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
