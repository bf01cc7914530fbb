"""Exact duplicates by Grace hash deduplication over complete texts.

1. Where documents are read, each bounded block is deduplicated by an open-addressing table, so that a text leaves a
   block once, however many copies it holds. What is left is written to the shared folder: a row per distinct text of
   a block, with the ids of its documents.
2. Those texts are dealt out by their hash. A task partitions what it gets into spill files by further bits of the
   hash, recursively, until a bucket fits an open-addressing table that compares complete contents. Spill files are
   unlinked when opened: they belong to one task, are read by no other and leave nothing behind.
3. The answer for a text goes back to the rows of its blocks, and from them to their documents. A hot text has a row
   per block at most, so no task gets more of a group than there are blocks.

Of equal texts the row with the largest doc_id stays. Null counts as empty, and all empty texts are equal. Repeated
rows (the same doc_id and text) are one group; all its rows with the largest doc_id count as kept. A null doc_id is
smaller than any other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import MARKS, blocks, chosen, stored, texts_of

BLOCK_BYTES = 16 << 20
#: Bytes of text that a bucket's table may hold.
TABLE_BYTES = 64 << 20
FANOUT = 16
LOCAL = "hash long, text string, text_sha256 string, ids array<long>, largest long, n long"
SMALLEST = -(1 << 63)


class OpenTable:
    """An open-addressing table from text to a running number; equal hashes are told apart by complete content."""

    def __init__(self, expected: int = 16):
        self.slots = [-1] * (1 << max(4, (2 * expected).bit_length()))
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def number(self, hash_: int, text: bytes) -> int:
        if 2 * len(self.texts) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (own := self.slots[at]) >= 0:
            if self.hashes[own] == hash_ and self.texts[own] == text:
                return own
            at = (at + 1) & mask
        self.slots[at] = own = len(self.texts)
        self.hashes.append(hash_)
        self.texts.append(text)
        return own

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots = [-1] * size
        for own, hash_ in enumerate(self.hashes):
            at = hash_ & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = own


def local_groups(docs: DataFrame) -> DataFrame:
    """A row per distinct text of a block: its hash, its digest, the ids of its documents and their largest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            table, digests, ids = OpenTable(block.num_rows), [], []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                content = text.encode()
                digest = hashlib.sha256(content)
                own = table.number(int.from_bytes(digest.digest()[:8], "little", signed=True), content)
                if own == len(ids):
                    ids.append([])
                    digests.append(digest.hexdigest())
                ids[own].append(doc)
            columns = [
                pa.array(table.hashes, pa.int64()),
                pa.array([x.decode() for x in table.texts], pa.string()),
                pa.array(digests),
                pa.array(ids, pa.list_(pa.int64())),
                pa.array([max((x for x in own if x is not None), default=None) for own in ids], pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
            ]
            names = ["hash", "text", "text_sha256", "ids", "largest", "n"]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=2_000)

    rows = texts_of(docs).mapInArrow(run, LOCAL)
    return rows.withColumn("row", F.monotonically_increasing_id())


class Spill:
    """Records of one bucket in a file that has no name any more."""

    def __init__(self):
        self.file, self.writer, self.bytes, self.rows = tempfile.TemporaryFile(), None, 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_stream(self.file, batch.schema)
        self.writer.write_batch(batch)
        self.bytes += batch.column("text").nbytes
        self.rows += batch.num_rows

    def read(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
        self.file.close()


def bucket_of(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Which of the spill files of a level: other bits of the hash at each."""
    return (hashes.view(np.uint64) >> np.uint64(60 - 4 * depth)) & np.uint64(FANOUT - 1)


def grace(batches: Iterable[pa.RecordBatch], limit: int, depth: int = 0) -> Iterator[pa.Table]:
    """What each record's text has in all: the largest id and the number of rows of its group."""
    held, size = [], 0
    batches = iter(batches)
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size > limit:
            break
    if size <= limit or depth == 15:  # no bits are left: what is together now is one text in the main
        if held:
            yield grouped(held if size <= limit else [*held, *batches])
        return
    spills = [Spill() for _ in range(FANOUT)]
    while held or (held := list(_next(batches))):
        batch = held.pop(0)
        which = bucket_of(batch.column("hash").to_numpy(), depth)
        for k in np.unique(which).tolist():
            spills[k].add(batch.filter(pa.array(which == k)))
    for spill in spills:
        yield from grace(spill.read(), limit, depth + 1)


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = next(batches, None)
    if batch is not None:
        yield batch


def grouped(batches: list[pa.RecordBatch]) -> pa.Table:
    """Deduplicate a bucket that fits."""
    own: list[int] = []
    largest: list[int] = []
    counts: list[int] = []
    table = OpenTable(sum(x.num_rows for x in batches))
    for batch in batches:
        for hash_, text, top, n in zip(*(batch.column(x).to_pylist() for x in ("hash", "text", "largest", "n")), strict=True):
            number = table.number(hash_, text.encode())
            own.append(number)
            top = SMALLEST if top is None else top
            if number == len(counts):
                counts.append(n)
                largest.append(top)
            else:
                counts[number] += n
                largest[number] = max(largest[number], top)
    rows = pa.concat_arrays([x.column("row") for x in batches])
    keep = [None if largest[i] == SMALLEST else largest[i] for i in own]
    sizes = [counts[i] for i in own]
    return pa.Table.from_arrays([rows, pa.array(keep, pa.int64()), pa.array(sizes, pa.int64())], ["row", "keep_id", "group_size"])


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per document: the id that stays of its group, the group's size, and the digest of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grace(batches, table_bytes):
            yield from table.to_batches(max_chunksize=10_000)

    local = stored(local_groups(docs), "texts")
    answers = (
        local.select("row", "hash", "text", "largest", "n")
        .repartition("hash")
        .mapInArrow(run, "row long, keep_id long, group_size long")
    )
    return (
        local.select("row", "text_sha256", "ids")
        .join(answers, "row")
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns; of rows that repeat doc_id and text, any one."""
    kept = exact_groups(docs).where("kept").select(
        F.col("doc_id").isNull().alias("_null"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.unhex("text_sha256").alias("_digest"),
    )
    return chosen(docs, kept.select(MARKS).distinct())
