"""Timestamps. A value without an offset is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_WATERSHED = 20_000_000_000  # larger magnitudes are milliseconds
_LAST_SECOND = 253_402_300_800  # 10000-01-01

_USUAL = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|\+00:00)?\z"
_CLOCK = r"(\d\d:\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
_OFFSET = r"([Zz]|[+\u2212-](?:[01]\d|2[0-3]):?[0-5]\d)?"
EDGE_ISO = rf"\A(\d{{4}}-\d\d-\d\d)(?:[Tt _]{_CLOCK}{_OFFSET})?\z"
NUMBER = r"\A[+-]?\d+(\.\d*)?\z"


def from_epoch(number: Column) -> Column:
    """Seconds, or milliseconds beyond the watershed; null past year 9999."""
    seconds = F.when(F.abs(number) > _EPOCH_WATERSHED, number / 1000).otherwise(number)
    return F.when(
        F.abs(seconds) < _LAST_SECOND, F.timestamp_micros(F.rint(seconds * 1_000_000).try_cast("long"))
    )


def from_iso(text: Column, pattern: str = EDGE_ISO) -> Column:
    """ISO-8601 text to an instant, null when it does not match or is no date."""
    date, clock = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    second, fraction = F.regexp_extract(text, pattern, 3), F.regexp_extract(text, pattern, 4)
    offset = F.regexp_extract(text, pattern, 5)
    return F.when(text.rlike(pattern), instant(date, clock, second, fraction, offset))


def instant(
    date: Column, clock: Column, second: Column, fraction: Column, offset: Column
) -> Column:
    """Assemble the captured pieces; empty pieces count as zero."""
    local = F.concat(
        date,
        F.lit("T"),
        F.when(clock == "", "00:00").otherwise(clock),
        F.lit(":"),
        F.when(second == "", "00").otherwise(second),
        F.lit("."),
        F.rpad(F.substring(fraction, 1, 6), 6, "0"),
        F.lit("Z"),
    )
    digits = F.regexp_replace(offset, r"\D", "")
    minutes = F.when(digits == "", F.lit(0)).otherwise(
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    )
    ahead = F.when(offset.rlike(r"\A[\u2212-]"), -minutes).otherwise(minutes)
    return F.timestamp_add("MINUTE", -ahead, local.try_cast("timestamp"))


def parse_edge_time(text: Column) -> Column:
    """Sender's timestamp text: ISO date or date-time, or a number of epoch units."""
    naive = text.rlike(r"[0-9]\z") & ~text.contains("+")
    usual = F.when(naive, F.concat(text, F.lit("Z"))).otherwise(text).try_cast("timestamp")
    return (
        F.when(text.rlike(_USUAL), usual)
        .when(text.rlike(NUMBER), from_epoch(text.try_cast("double")))
        .otherwise(from_iso(text))
    )


# Forms of the wire decoder: a basic or extended date, any single character
# between date and time, hours down to fractions, offsets down to seconds.
_WIRE_ISO = (
    r"\A(\d{4})-?(\d\d)-?(\d\d)"
    r"(?:[\s\S](\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?"
    r"([Zz]|[+-]\d\d(?::?\d\d(?::?\d\d(?:\.\d+)?)?)?)?)?\z"
)


# A week date, wholly extended or wholly basic; without a day it is a Monday.
_WEEK = r"\A(\d{4})(?:-W(\d\d)(?:-(\d))?|W(\d\d)(\d)?)(?=\z|[^0-9-]|-[^0-9])"


def week_date(text: Column) -> Column:
    """The calendar date `yyyy-MM-dd` of a leading week date (`2024-W05-3`); null for a week or day that is none."""

    def piece(*numbers: int) -> Column:
        return F.concat(*[F.regexp_extract(text, _WEEK, n) for n in numbers])

    year, week = piece(1).try_cast("int"), piece(2, 4).try_cast("int")
    day = F.when(piece(3, 5) == "", F.lit(1)).otherwise(piece(3, 5).try_cast("int"))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # lies in the first week of its year
    found = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    # the 53rd week of a shorter year is the first of the next one
    right = day.between(1, 7) & (F.weekofyear(found) == week) & (year > 0)
    return F.when(text.rlike(_WEEK) & right, F.date_format(found, "yyyy-MM-dd"))


def parse_wire_time(text: Column) -> Column:
    """Time text of a wire message; null when it cannot be read."""
    # a week date goes on as the calendar date it stands for
    dated = F.concat(week_date(text), F.regexp_replace(text, _WEEK, ""))
    return _wire_time(F.when(text.rlike(_WEEK), dated).otherwise(text))


def _wire_time(text: Column) -> Column:

    def piece(n: int) -> Column:
        return F.regexp_extract(text, _WIRE_ISO, n)

    date = F.concat_ws("-", piece(1), piece(2), piece(3))
    hour = F.when(piece(4) == "", "00").otherwise(piece(4))
    minute = F.when(piece(5) == "", "00").otherwise(piece(5))
    general = instant(date, F.concat_ws(":", hour, minute), piece(6), piece(7), _padded(piece(8)))
    return (
        F.when(text.rlike(_USUAL) & text.rlike(r"(Z|\+00:00)\z"), text.try_cast("timestamp"))
        .when(text.rlike(_WIRE_ISO), general)
    )


def _padded(offset: Column) -> Column:
    """`+02` -> `+0200`; longer offsets keep hours and minutes."""
    return F.when(F.length(offset) == 3, F.concat(offset, F.lit("00"))).otherwise(offset)


def iso_text(instant_column: Column) -> Column:
    """`2024-01-31T00:00:00+00:00`, with microseconds only when there are any."""
    whole = F.date_format(instant_column, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(instant_column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(instant_column) % 1_000_000 == 0, whole).otherwise(exact)
