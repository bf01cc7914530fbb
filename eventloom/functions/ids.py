"""Event and project identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_key(received_at: Column, request_id: Column, position: Column) -> Column:
    """Version-7 identifier of the `position`-th event of a request.

    It is a function of where the event came from, so a replay of the same
    source rows yields the same ids, while a client's retry (a new request)
    does not collide.  Layout: 48 bits of milliseconds, the version, 12 bits of
    position so that ids sort in batch order, the variant, then hash bits.  From
    position 4095 on the 12 bits are full, and 32 bits behind the variant go on
    counting, so ids sort in batch order at any position.
    """
    digest = F.sha2(F.concat_ws(":", request_id, position.cast("string")), 256)
    millis = F.lpad(F.lower(F.hex(F.unix_millis(received_at))), 12, "0")
    order = F.lpad(F.lower(F.hex(F.least(position, F.lit(4095)))), 3, "0")
    variant = F.substring(F.lit("89ab"), _quarter(digest), F.lit(1))
    beyond = F.lpad(F.lower(F.hex(position - 4095)), 8, "0")
    far = position >= 4095
    return F.concat(
        F.substring(millis, 1, 8),
        F.lit("-"),
        F.substring(millis, 9, 4),
        F.lit("-7"),
        order,
        F.lit("-"),
        F.when(far, "8").otherwise(variant),
        F.when(far, F.substring(beyond, 1, 3)).otherwise(F.substring(digest, 2, 3)),
        F.lit("-"),
        F.when(far, F.concat(F.substring(beyond, 4, 5), F.substring(digest, 5, 7))).otherwise(F.substring(digest, 5, 12)),
    )


def _quarter(digest: Column) -> Column:
    """1..4 from the first hexadecimal digit."""
    digit = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int")
    return F.pmod(digit, F.lit(4)) + F.lit(1)


# Days that a time-ordered id may carry, and the number of slots of all other ids.
_FIRST_MILLIS = 946_684_800_000  # 2000-01-01
_END_MILLIS = 4_102_444_800_000  # 2100-01-01
HASH_SLOTS = 8


def id_slot(event_id: Column) -> Column:
    """The part of a store that an id belongs to, from the id alone, so that equal ids share it.

    A version-7 id belongs to its day of receipt (`d20240131`); one of another
    version, or with a time out of bounds, to one of `HASH_SLOTS` parts by hash.
    """
    millis = F.conv(F.concat(F.substring(event_id, 1, 8), F.substring(event_id, 10, 4)), 16, 10).try_cast("long")
    ordered = event_id.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-")
    dated = ordered & (millis >= _FIRST_MILLIS) & (millis < _END_MILLIS)
    return F.when(dated, F.concat(F.lit("d"), F.date_format(F.timestamp_millis(millis), "yyyyMMdd"))).otherwise(
        F.concat(F.lit("h"), F.pmod(F.xxhash64(event_id), F.lit(HASH_SLOTS)).cast("string"))
    )


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form, or null when `text` is no UUID.

    Plain, hyphenated, braced and `urn:uuid:` spellings are all taken.
    """
    bare = F.lower(F.regexp_replace(text, r"urn:|uuid:", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\A[{}]+|[{}]+\z", ""), "-", "")
    hyphenated = F.concat_ws(
        "-",
        F.substring(bare, 1, 8),
        F.substring(bare, 9, 4),
        F.substring(bare, 13, 4),
        F.substring(bare, 17, 4),
        F.substring(bare, 21, 12),
    )
    usual = text.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
    return F.when(usual, text).when(bare.rlike(r"\A[0-9a-f]{32}\z"), hyphenated)
