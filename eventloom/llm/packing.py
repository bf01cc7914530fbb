"""Best-fit packing: token sequences of at most a fixed length, filled by bounded-space online best-fit.

Each task tokenizes the documents it reads and writes one narrow row per piece to the shared folder. The pieces are
then dealt out in shares of about `SHARE` (by a hash of the document, so no share is larger for a hot source), and
each share is packed online: a fixed number of open bins, found through a bitset keyed by free space. A piece goes to
the open bin with the least room that still holds it; where none does, a bin opens, and beyond the fixed number the
fullest closes first. Only the bins still open at a share's end are left less than full by the split in shares.

Where a text holds an added token of the vocabulary (`<|endoftext|>`), that is its own id, as the `tokenizers` library has
it by default; what stands between added tokens is tokenized each for itself.

Null and empty texts are the closing id alone, one piece of length 1. Repeated rows are packed each for itself, an
empty table gives an empty result, and other columns are ignored. Documents longer than the capacity are cut into
full pieces; the first takes what is over.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.chunks import Pieces
from eventloom.llm.shared import blocks, stored, texts_of
from eventloom.llm.words import encoded

BLOCK_BYTES = 8 << 20
CAPACITY = 2048
OPEN_BINS = 8192
#: Pieces in a share.
SHARE = 250_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Added:
    """The ids of texts in which added tokens have ids of their own; of those that begin at one place the longest counts."""

    def __init__(self, plain: Pieces, added: dict[bytes, int]):
        self.plain, self.of = plain, {x: struct.pack("<I", n) for x, n in added.items()}
        self.split = re.compile(b"(%s)" % b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))).split

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text."""
        parts = [self.split(x) for x in texts]  # every second part is an added token
        coded = iter(self.plain.ids([x for own in parts for x in own[::2]]))
        return [
            b"".join([self.of[x] if k % 2 else next(coded) for k, x in enumerate(own)]) if len(own) > 1 else next(coded)
            for own in parts
        ]


_ENCODERS: dict[tuple[str, str], Pieces] = {}


def encoder(path: str, pattern: str) -> Pieces:
    """Ids by the vocabulary of a `tokenizers` file, added tokens as ordinary text; one for each Python worker.

    The ids of a byte-level vocabulary are in merge order, which is all that the rank-based encoder needs; its own
    library would take five times as long for the same ids.
    """
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special, of = {x["content"] for x in content["added_tokens"]}, letters()
        ranks = {bytes(map(of.__getitem__, k)): v for k, v in content["model"]["vocab"].items() if k not in special}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(words: list[str]) -> list[bytes]:
            coded = map(own.encode_ordinary, words)
            return [struct.pack(f"<{len(x)}I", *x) for x in coded]

        _ENCODERS[path, pattern] = Pieces(pattern, encode)
    return _ENCODERS[path, pattern]


def whole_encoder(path: str, pattern: str) -> Pieces | Added:
    """Ids by the vocabulary and the added tokens of a `tokenizers` file."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if odd := [x["content"] for x in added if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]:
        raise ValueError(f"added tokens that depend on what is around them are not supported: {odd}")
    plain = encoder(path, pattern)
    return Added(plain, {x["content"].encode(): x["id"] for x in added}) if added else plain


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of so many tokens."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def document_pieces(
    docs: DataFrame, path: str, pattern: str, end: int = 0, capacity: int = CAPACITY, added: bool = False
) -> DataFrame:
    """One row per piece, with the CRC of its ids; `copy` tells repeated rows of a doc_id apart.

    `added`: whether added tokens in texts have their own ids; otherwise they are ordinary text.
    """
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (whole_encoder if added else encoder)(path, pattern)
        for block in blocks(batches, BLOCK_BYTES):
            rows: list[tuple] = []
            for doc, copy, ids in zip(
                block.column("doc_id").to_pylist(),
                block.column("copy").to_pylist(),
                own.ids(encoded(block.column("text"))),
                strict=True,
            ):
                ids += closing
                rows += [
                    (doc, copy, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))
                    for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity))
                ]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)

    return texts_of(docs).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


class BestFit:
    """Online packing with a fixed number of open bins."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0  # which free spaces have open bins
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.room[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.room[free].pop()
        if not self.room[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    """Give each piece a sequence and a place in it."""
    shares = max(1, -(-pieces.count() // share))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins = None, BestFit(capacity, open_bins)
        for batch in batches:
            numbers, offsets = [], []
            for which, length in zip(batch.column("share").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if which != own:
                    own, bins = which, BestFit(capacity, open_bins)
                number, offset = bins.put(length)
                numbers.append(which << 40 | number)
                offsets.append(offset)
            kept = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    order = F.xxhash64("doc_id", "copy", "piece")
    return (
        pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shares)))
        .repartition(shares, "share")
        .sortWithinPartitions("share", order, "doc_id", "copy", "piece")
        .mapInArrow(run, SCHEMA)
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack(stored(document_pieces(docs, path, pattern, added=True), "pieces"), **options)
