"""Prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor_units(price: Column) -> Column:
    """Major to minor units, rounding the binary product half to even."""
    return F.rint(price * F.lit(100.0)).try_cast("long")
