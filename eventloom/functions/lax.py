"""Lenient typed readings of an untrusted JSON value.

A value comes as its text and its *odd kind*: null for a value of the kind the
field expects (and for an absent one), else what it is instead - STRING, BIGINT,
DECIMAL(..), DOUBLE, BOOLEAN, VOID (an explicit null), ARRAY<..> or OBJECT<..>.
Ordinary events have no odd kinds, so they cost next to nothing to carry.

Each type has a reader, to the typed value, and a diagnosis, which names the
error type of a value that could not be read (null when there is none) from the
value already read.  An absent value and an explicit null both read as null
without an error; required fields add their own check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import times

_DIGITS = r"[0-9](?:_?[0-9])*"
_INT = rf"\A\s*[+-]?{_DIGITS}(?:\.0+)?\s*\z"
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
# Blanks around it and `_` between its digits do not go together in a float.
_FLOAT = (
    rf"\A\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+){_EXPONENT}\s*\z"
    rf"|\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS}){_EXPONENT}\z"
    r"|(?i)\A\s*[+-]?(?:inf|infinity|nan)\s*\z"
)


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def odd_for_text(value: Column) -> Column:
    """Odd kind of a variant where text is expected."""
    kind = F.schema_of_variant(value)
    return F.when(kind != "STRING", kind)


def odd_for_number(value: Column) -> Column:
    """Odd kind of a variant where a number is expected."""
    kind = F.schema_of_variant(value)
    return F.when(~_is_number(kind), kind)


def odd_for_int(value: Column) -> Column:
    """Odd kind of a variant where a whole number is expected.

    A number written with an exponent counts as odd, for its own size error.
    """
    kind = F.schema_of_variant(value)
    return F.when((kind != "BIGINT") & ~kind.startswith("DECIMAL"), kind)


def wrong(odd: Column) -> Column:
    """Whether there is a value, and of another kind."""
    return odd.isNotNull() & (odd != "VOID")


def _plain(text: Column, pattern: str) -> Column:
    """Number text without blanks around it and `_` between digits, if it is one."""
    # `(?U)` lets `\s` match every Unicode blank.
    return F.when(text.rlike(f"(?U){pattern}"), F.regexp_replace(text, r"(?U)[_\s]", ""))


def read_text(text: Column, odd: Column) -> Column:
    return F.when(odd.isNull(), text)


def _read_number(text: Column, odd: Column, pattern: str) -> Column:
    return (
        F.when(odd.isNull() | (odd == "DOUBLE"), text.try_cast("double"))
        .when(odd == "STRING", _plain(text, pattern).try_cast("double"))
        .when(odd == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
    )


def read_float(text: Column, odd: Column) -> Column:
    return _read_number(text, odd, _FLOAT)


def diagnose_float(odd: Column, read: Column) -> Column:
    return F.when(
        wrong(odd) & read.isNull(),
        F.when(odd == "STRING", "float_parsing").otherwise("float_type"),
    )


def read_int(text: Column, odd: Column) -> Column:
    """Whole number as a double, exact over the accepted range."""
    return _read_number(text, odd, _INT)


def diagnose_int(odd: Column, read: Column) -> Column:
    unread = F.when(odd == "STRING", "int_parsing").otherwise("int_type")
    return (
        F.when(wrong(odd) & read.isNull(), unread)
        .when((odd == "DOUBLE") & (F.abs(read) == float("inf")), "finite_number")
        .when((odd == "DOUBLE") & (F.abs(read) >= 2.0**63), "int_parsing_size")
        .when(read != F.rint(read), "int_from_float")
    )


def read_time(text: Column, odd: Column) -> Column:
    return F.when(odd.isNull(), times.parse_edge_time(text)).when(
        _is_number(odd), times.from_epoch(text.try_cast("double"))
    )


def diagnose_time(odd: Column, read: Column) -> Column:
    return F.when(
        read.isNull(),
        F.when(odd.isNull(), "datetime_from_date_parsing")
        .when(_is_number(odd), "datetime_parsing")
        .otherwise("datetime_type"),
    )
