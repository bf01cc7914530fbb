"""Terms of texts, and a query set in blocks.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from eventloom.llm.shared import stored

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_OUTSIDE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split at once.
PART = 1 << 20


def split(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = _OUTSIDE.search(text, end)
            end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


class Vocabulary:
    """Numbers from 1 for the terms of a query set; 0 is any other term."""

    def __init__(self, texts: Iterable[bytes]):
        self.number: dict[bytes, int] = {}
        self.texts = [[self.number.setdefault(x, len(self.number) + 1) for p in split(t) for x in p] for t in texts]

    def numbers(self, text: bytes) -> np.ndarray:
        """The number of each term of a text."""
        get = self.number.get
        parts = [np.fromiter(map(get, p, repeat(0)), np.int32, len(p)) for p in split(text)]
        return np.concatenate([np.empty(0, np.int32), *parts])


def query_blocks(queries: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """The distinct rows (key, text) of a query set, in blocks of a bounded size that the driver may hold and send out.

    A block has `size` bytes on average and at most twice that, or one longer text. Null texts are empty, empty ones are
    left out. There is one block at least, if only an empty one.
    """
    rows = queries.select(key, F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").distinct()
    weight = (F.octet_length("text") + 64).cast("long")
    total, longest = rows.agg(F.sum(weight), F.max(weight)).first()
    many = max(1, -(-(total or 0) // size))
    while many > 1:
        block = F.pmod(F.xxhash64(key, "text"), F.lit(many))
        if rows.groupBy(block).agg(F.sum(weight).alias("w")).agg(F.max("w")).first()[0] <= max(2 * size, longest):
            rows = stored(rows.withColumn("_block", block).repartition(many, "_block"), "queries")
            for k in range(many):
                yield rows.where(F.col("_block") == k).drop("_block").collect()
            return
        many *= 2
    yield rows.collect()
