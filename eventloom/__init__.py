"""Clickstream collection and analytics as Spark jobs.

Raw JSON requests are validated, attributed to a tenant, metered and split into
accepted events and explained rejects; accepted events are stored idempotently,
read back and summarised.  Every operator is a function from DataFrame to
DataFrame, so any of them can run in batch or inside a micro-batch.
"""

from eventloom.settings import Settings, configure

__all__ = ["Settings", "configure"]
