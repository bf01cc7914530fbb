"""Shallow merge of JSON objects held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_entries(text: Column) -> Column:
    return F.from_json(text, "map<string,variant>")


def merged(base: Column, *overlays: Column) -> Column:
    """`base` with each overlay's keys laid over it, left to right, as JSON text.

    A null base stays null and a null overlay changes nothing.  A key whose value
    is an explicit null in an overlay is kept as null.
    """
    entries = as_entries(base)
    for overlay in overlays:
        laid = F.coalesce(as_entries(overlay), as_entries(F.lit("{}")))
        below = F.map_filter(entries, lambda key, _: ~F.map_contains_key(laid, key))
        entries = F.map_concat(below, laid)
    return F.to_json(entries)
