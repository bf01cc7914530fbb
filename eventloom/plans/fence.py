"""Keeping expensive columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with filters on `columns` kept above their computation.

    The optimizer moves a filter below projections by repeating the projected
    expressions inside it.  For a parsed and validated event that would parse and
    validate twice, and over several stages the copies multiply.  A filter does
    not pass a generator whose output it uses, so the columns come out of a
    one-row `inline`.
    """
    others = [name for name in df.columns if name not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))
