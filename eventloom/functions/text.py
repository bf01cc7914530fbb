"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def words_of(code: Column) -> Column:
    """`NotFoundError` -> ["not", "found", "error"]."""
    spaced = F.lower(F.regexp_replace(code, "([A-Z])", " $1"))
    return F.filter(F.split(spaced, r"\s+"), lambda word: word != "")


def title_of(code: Column) -> Column:
    """`NotFoundError` -> "Not Found Error"."""
    return F.initcap(F.array_join(words_of(code), " "))
