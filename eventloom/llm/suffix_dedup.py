"""Removal of byte strings that an earlier document holds too, by range-partitioned suffix sorting.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document of a smaller doc_id. All texts are
judged as they came, as UTF-8; matches never cross documents.

Sorting every suffix would move a hundred times the corpus. So suffixes are taken at anchors only: the positions whose
`GRAM` leading bytes have the smallest hash within some string of `LENGTH` bytes. Equal strings have equal anchors, and
every string has one, so nothing is missed.

1. Documents are dealt into blocks by a hash of their id. Each block sends the grams of its anchors, once each; grams
   that two blocks have are reported back, with those that are hot.
2. Each block sends its anchors of such grams, and of grams that several of its own documents share, with the bytes
   around them: everything that a string through the anchor can hold. Of equal surroundings only the smallest document's
   go on; the others are known to be repeated. Anchors are range-partitioned by their leading bytes, between splitters
   sampled from the corpus. Anchors of a hot gram go string by string instead, each to where its hash leads, so that no
   task gets more of one than there are blocks.
   What goes from one block to one bucket is one line. There are as many of these as blocks times buckets, the only
   thing that grows with the square of the input, so nothing but packing and unpacking is done line by line.
3. A bucket sorts its suffixes by multikey quicksort on characters of eight bytes, and what precedes them likewise, and
   compares neighbours. For each offset of a string to its anchor, runs of neighbours that agree long enough on both
   sides are equal strings; all but those of the run's smallest document are repeated. Splitters are no longer than a
   gram, so equal strings never lie on two sides of a boundary.
4. The answers meet their block, which cuts the bytes out.

Null and empty texts have no bytes and lose none, as do texts shorter than `LENGTH`. Rows of the same doc_id are one
document: they take nothing from each other. A null doc_id is smaller than any other. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.llm.shared import free_name, marked, stored, texts_of
from eventloom.llm.words import encoded, mix

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of suffixes, and the most buckets.
BUCKET_BYTES = 4 << 20
BUCKETS = 50_000
#: Documents that splitters are sampled from, for each bucket.
SAMPLE = 16
#: Anchors of one gram beyond which it is hot.
HOT = 8192
SEGMENT = 1 << 20
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
SMALLEST = -(1 << 63)
GRAMS = "bucket int, block int, grams binary, sizes binary"
TOLD = "bucket int, block int, grams binary, hot binary"
ANCHORS = "bucket int, block int, known boolean, n int, packed binary"
FOUND = "block int, n int, packed binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number each."""
    n = len(data) - 7
    out = np.empty(max(0, n), dtype=np.uint64)
    for r in range(min(8, max(0, n))):
        own = data[r : r + (n - r + 7) // 8 * 8]
        out[r::8] = np.frombuffer(own.tobytes(), dtype="<u8")
    return out


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest or largest of each run of so many."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def anchors(data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors, and a hash of the gram at each. `room`: bytes from each position to its text's end."""
    positions, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    window = LEFT + 1
    for begin in range(0, len(data), SEGMENT):
        low, high = max(0, begin - LEFT), min(len(data), begin + SEGMENT + LENGTH - 1)
        part = eights(data[low:high])
        if len(part) < LENGTH - 7:
            continue
        gram = part[:-8] * C1 + (part[8:] ^ (part[8:] >> np.uint64(29))) * C2
        gram ^= gram >> np.uint64(32)
        order = ((gram * C3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = slide(order, window, np.minimum)
        least[room[low : low + len(least)] < LENGTH] = 0  # no string starts there
        most = slide(np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(LEFT, np.uint32)]), window, np.maximum)
        at = np.flatnonzero(most[: len(order)] == order)
        at = at[(at + low >= begin) & (at + low < begin + SEGMENT)]
        positions.append(at + low)
        grams.append(gram[at])
    return np.concatenate(positions), np.concatenate(grams)


@dataclass
class Block:
    """The texts of a block, in an order that depends on them alone."""

    order: np.ndarray
    texts: list[bytes]
    docs: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        texts = encoded(table.column("text"))
        docs = np.array([SMALLEST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        marks = [hashlib.blake2b(x, digest_size=16).digest() for x in texts]
        order = np.array(sorted(range(len(texts)), key=lambda i: (docs[i], marks[i])), dtype=np.int64)
        texts = [texts[i] for i in order]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        return cls(order, texts, docs[order], np.cumsum(lengths) - lengths, data)

    @cached_property
    def room(self) -> np.ndarray:
        """Bytes from each position to its text's end."""
        ends = np.append(self.starts[1:], len(self.data))
        return np.repeat(ends, ends - self.starts) - np.arange(len(self.data))


def bytes_of(x: np.ndarray) -> np.ndarray:
    """Numbers of eight bytes, as a line for each of these: all lowest bytes, all next ones, and so on."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def numbers_of(lines: list[np.ndarray]) -> np.ndarray:
    return np.ascontiguousarray(np.concatenate(lines, axis=1).T).view("<i8").ravel()


def packed(*parts: np.ndarray) -> bytes:
    """Some columns on their way through a shuffle: neighbours are sorted and much alike, so they compress well."""
    return _COMPRESSOR.compress(b"".join([x.tobytes() for x in parts]))


def unpacked(whole: bytes, n: int, *widths: int) -> list[np.ndarray]:
    """The columns of `packed`, of so many bytes a line, one behind another."""
    data = np.frombuffer(_DECOMPRESSOR.decompress(whole), np.uint8)
    ends = np.cumsum(widths) * n
    return [data[end - width * n : end] for end, width in zip(ends.tolist(), widths, strict=True)]


def runs(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Numbers as a column of bytes, so many in each row."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).cast(pa.binary())


def flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of `runs`."""
    parts, lengths = [np.empty(0, kind)], [np.empty(0, np.int64)]
    for chunk in column.cast(pa.large_binary()).chunks:
        if not len(chunk):
            continue
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        lengths.append(np.diff(ends) // np.dtype(kind).itemsize)
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], kind, int(lengths[-1].sum()), int(ends[0])))
    return np.concatenate(parts), np.concatenate(lengths)


def dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each gram, and 32 bits that stand for it there.

    A gram that shares them with another one may be asked for in vain, or be dealt as hot, everywhere alike; no string is lost.
    """
    which = (grams % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    return which, (grams // np.uint64(buckets)).astype(np.uint32)


def placed_at(which: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Bucket and bits as one number."""
    return which.astype(np.uint64) << np.uint64(32) | code


def own_grams(block: pa.Table, buckets: int) -> pa.Table:
    """What a block sends first: its distinct grams, and the logarithm of how many anchors each has."""
    own = Block.of(block)
    grams, counts = np.unique(anchors(own.data, own.room)[1], return_counts=True)
    size = np.ceil(np.log2(counts)).astype(np.uint8)
    which, code = dealt(grams, buckets)
    order = np.argsort(which, kind="stable")
    each = np.bincount(which, minlength=buckets)
    held = np.flatnonzero(each)
    number = pa.array(np.full(len(held), block.column("block")[0].as_py()), pa.int32())
    columns = [pa.array(held, pa.int32()), number, runs(code[order], each[held]), runs(size[order], each[held])]
    return pa.Table.from_arrays(columns, schema=arrow(GRAMS))


def shared_grams(rows: pa.Table, hot: int) -> pa.Table:
    """For each block, its grams that other blocks have, and those of them that are hot anywhere."""
    grams, lengths = flat(rows.column("grams"), "<u4")
    sizes, _ = flat(rows.column("sizes"), "u1")
    distinct, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
    total = np.bincount(at, np.exp2(sizes.astype(np.float64)), len(distinct))
    line = np.repeat(np.arange(len(lengths)), lengths)
    several, many = (counts > 1)[at], (total > hot)[at]
    told = [runs(grams[x], np.bincount(line[x], minlength=len(lengths))) for x in (several, many)]
    return pa.Table.from_arrays([rows.column(c).combine_chunks() for c in ("bucket", "block")] + told, schema=arrow(TOLD))


def surroundings(own: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around some positions, zero beyond the text, and how many there are on each side."""
    row = np.searchsorted(own.starts, at, side="right") - 1
    left = np.minimum(LEFT, at - own.starts[row])
    right = np.minimum(LENGTH, own.room[at])
    wide = np.concatenate([np.zeros(LEFT, np.uint8), own.data, np.zeros(LENGTH, np.uint8)])
    around = sliding_window_view(wide, WIDTH)[at]
    edge = np.flatnonzero((left < LEFT) | (right < LENGTH))
    offsets = np.arange(-LEFT, LENGTH)
    around[edge] *= (offsets >= -left[edge, None]) & (offsets < right[edge, None])
    return around, left, right


def offsets_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The offsets of all strings through an anchor with so many bytes on either side, as bits."""
    mask = np.zeros(len(left), dtype=np.int64)
    for o in range(LEFT + 1):
        mask |= ((left >= o) & (right >= LENGTH - o)).astype(np.int64) << o
    return mask


def told_of(mark: np.ndarray, answers: pa.Table, column: str) -> np.ndarray:
    """Which of some grams are among the answers."""
    code, lengths = flat(answers.column(column), "<u4")
    which = np.repeat(answers.column("bucket").to_numpy(), lengths)
    return np.isin(mark, placed_at(which, code))


def sent_anchors(block: pa.Table, answers: pa.Table, splitters: np.ndarray, buckets: int) -> Iterator[dict]:
    """What a block sends second: anchors with their surroundings, and what it knows to be repeated."""
    if not block.num_rows:
        return
    own = Block.of(block)
    number = block.column("block")[0].as_py()
    at, grams = anchors(own.data, own.room)
    if not len(at):
        return
    row = np.searchsorted(own.starts, at, side="right") - 1
    mark = placed_at(*dealt(grams, buckets))
    asked, hot_gram = (told_of(mark, answers, x) for x in ("grams", "hot"))
    order = np.lexsort((own.docs[row], grams))
    starts = np.flatnonzero(np.diff(grams[order], prepend=grams[order][0] ^ np.uint64(1)))
    docs = own.docs[row[order]]
    mixed = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    asked[order] |= np.repeat(mixed, np.diff(np.append(starts, len(order))))

    plain = at[asked & ~hot_gram]
    heads = sliding_window_view(own.data, GRAM)[plain].view(f"S{GRAM}").ravel()
    yield from sent(own, number, plain, np.searchsorted(splitters, heads, side="right"), buckets, string=False)
    # every string through a hot anchor, by its start; equal ones follow each other, so that they are met as such
    some = at[asked & hot_gram]
    through = np.zeros(len(own.data) + 1, dtype=np.int32)
    np.add.at(through, np.maximum(some - LEFT, 0), 1)
    np.add.at(through, some + 1, -1)
    begins = np.flatnonzero(np.cumsum(through[:-1], dtype=np.int32) > 0)
    begins = begins[own.room[begins] >= LENGTH]
    if not len(begins):
        return
    words = np.ndarray(len(own.data) - 7, dtype="<u8", buffer=own.data, strides=(1,))
    code = np.zeros(len(begins), dtype=np.uint64)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        code = mix(code * C1 + words[begins + k])
    which = (code % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(which, kind="stable")
    for i in range(0, len(order), SEGMENT // 8):
        part = order[i : i + SEGMENT // 8]
        yield from sent(own, number, begins[part], which[part], buckets, string=True)


def sent(own: Block, number: int, at: np.ndarray, which: np.ndarray, buckets: int, string: bool) -> Iterator[dict]:
    """Some positions with their surroundings, or with the string that starts there, each to a bucket."""
    if not len(at):
        return
    row = np.searchsorted(own.starts, at, side="right") - 1
    around, left, right = surroundings(own, at)
    if string:  # only the string that starts there
        left = np.zeros_like(left)
        around[:, :LEFT] = 0
        key = around[:, LEFT:]
    else:
        key = np.concatenate([around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
    order, alike = multikey_order(key)
    run = np.cumsum(np.concatenate([[True], alike < key.shape[1]])) - 1
    docs = own.docs[row[order]]
    first = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, run, docs)
    later = docs > first[run]
    gone = order[later]
    if len(gone):
        mask = offsets_of(left[gone], right[gone])
        yield {
            "bucket": number % buckets, "block": number, "known": True, "n": len(gone),
            "packed": packed(bytes_of(at[gone]), bytes_of(mask)),
        }
    kept = order[~later]
    kept = kept[np.argsort(which[kept].astype(np.min_scalar_type(buckets)), kind="stable")]
    which, around, left, right = which[kept], around[kept], left[kept].astype(np.uint8), right[kept].astype(np.uint8)
    doc, at = bytes_of(own.docs[row[kept]]), bytes_of(at[kept])
    cuts = [*np.flatnonzero(which[1:] != which[:-1]).tolist(), len(kept) - 1]
    begin = 0
    for end in (x + 1 for x in cuts):
        yield {
            "bucket": int(which[begin]), "block": number, "known": False, "n": end - begin,
            "packed": packed(*(x[begin:end] for x in (around, left, right)), *(x[:, begin:end] for x in (doc, at))),
        }
        begin = end


def eights_of(rows: np.ndarray) -> np.ndarray:
    """Lines of bytes as lines of characters of eight bytes, which order as the bytes do."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of lines of bytes, and how many leading bytes each has in common with the one before it.

    Multikey quicksort on characters of eight bytes: order by one character, then go on with the next only inside runs
    that are equal so far.
    """
    characters = eights_of(rows)
    order = np.argsort(characters[:, 0], kind="stable")
    tied = np.zeros(len(order), dtype=bool)  # equal so far to the one before
    tied[1:] = characters[order[1:], 0] == characters[order[:-1], 0]
    for k in range(1, characters.shape[1]):
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        places = np.flatnonzero(open_)
        if not len(places):
            break
        run = np.cumsum(~tied)[places]
        some = order[places]
        order[places] = some[np.lexsort((characters[some, k], run))]
        again = places[tied[places]]
        tied[again] = characters[order[again], k] == characters[order[again - 1], k]
    same = rows[order[1:]] == rows[order[:-1]]
    return order, np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) if len(order) > 1 else np.empty(0, np.int64)


def repeated(around: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor, the offsets of its strings that an anchor of a smaller document has too, as bits."""
    sides = []
    for rows in (around[:, LEFT:], around[:, LEFT - 1 :: -1] if LEFT else around[:, :0]):
        sides.append(multikey_order(np.ascontiguousarray(rows)))
    mask = np.zeros(len(doc), dtype=np.int64)
    classes = np.empty((2, len(doc)), dtype=np.int64)
    paired = np.empty((2, len(doc)), dtype=bool)  # not alone in their class
    for o in range(LEFT + 1):
        for side, pair, (order, alike), reach in zip(classes, paired, sides, (LENGTH - o, o), strict=True):
            apart = np.concatenate([[True], alike < reach, [True]])
            side[order] = np.cumsum(apart[:-1])
            pair[order] = ~(apart[:-1] & apart[1:])
        use = np.flatnonzero((left >= o) & (right >= LENGTH - o) & paired[0] & paired[1])
        if len(use) < 2:
            continue
        code = classes[0, use] * (len(doc) + 1) + classes[1, use]
        order = np.argsort(code)
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        first = np.minimum.reduceat(doc[use[order]], starts)
        later = doc[use[order]] > np.repeat(first, np.diff(np.append(starts, len(order))))
        mask[use[order[later]]] |= 1 << o
    return mask


def sorted_bucket(rows: pa.Table) -> Iterator[dict]:
    """Per block, which strings of its anchors are repeated."""
    known, block, n, whole = (rows.column(c).to_pylist() for c in ("known", "block", "n", "packed"))
    for i, passed in enumerate(known):
        if passed:
            yield {"block": block[i], "n": n[i], "packed": whole[i]}
    fresh = [i for i, passed in enumerate(known) if not passed]
    if not fresh:
        return
    parts = [unpacked(whole[i], n[i], WIDTH, 1, 1, 8, 8) for i in fresh]
    around, left, right = (np.concatenate([x[k] for x in parts]) for k in range(3))
    doc = numbers_of([x[3].reshape(8, -1) for x in parts])
    mask = repeated(around.reshape(-1, WIDTH), left, right, doc)
    ends = np.cumsum([n[i] for i in fresh])
    hits = np.flatnonzero(mask)
    held = bytes_of(mask[hits])
    cuts = [0, *np.searchsorted(hits, ends).tolist()]
    for i, x, end, a, b in zip(fresh, parts, ends.tolist(), cuts, cuts[1:], strict=False):
        if b > a:
            at = x[4].reshape(8, -1)[:, hits[a:b] - (end - n[i])]
            yield {"block": block[i], "n": b - a, "packed": packed(at, held[:, a:b])}


def cut(block: pa.Table, found: pa.Table) -> Iterator[dict]:
    """Per document, what is left without the bytes that repeated strings cover; in the block's own order of texts."""
    if not block.num_rows:
        return
    own = Block.of(block)
    cover = np.zeros(len(own.data) + 1, dtype=np.int32)
    parts = [unpacked(x, n, 8, 8) for x, n in zip(found.column("packed").to_pylist(), found.column("n").to_pylist(), strict=True)]
    if parts:
        start, bits = (numbers_of([x[k].reshape(8, -1) for x in parts]) for k in range(2))
        first, last = bits & ~(bits << 1), bits & ~(bits >> 1)  # strings of neighbouring offsets cover one range
        for o in range(LEFT + 1):
            np.add.at(cover, start[(last >> o) & 1 == 1] - o, 1)
            np.add.at(cover, start[(first >> o) & 1 == 1] - o + LENGTH, -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    ids = block.column("doc_id").to_pylist()
    for i, (begin, text) in enumerate(zip(own.starts.tolist(), own.texts, strict=True)):
        flags = gone[begin : begin + len(text)]
        removed = int(flags.sum())
        kept = np.frombuffer(text, np.uint8)[~flags].tobytes() if removed else text
        edges = int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum()) if removed else 0
        yield {
            "line": int(own.order[i]),
            "doc_id": ids[own.order[i]],
            "n_bytes": len(text),
            "n_removed": removed,
            "n_spans": edges,
            "kept": kept,
        }


def digests(block: pa.Table, found: pa.Table) -> pa.Table:
    rows = ({**x, "kept_sha256": hashlib.sha256(x["kept"]).hexdigest()} for x in cut(block, found))
    return as_table(rows, arrow(RESULT))


def cleaned(block: pa.Table, found: pa.Table, schema: pa.Schema) -> pa.Table:
    """The block's rows with all their columns and what is left of their texts."""
    rows = list(cut(block, found))
    if not rows:
        return schema.empty_table()
    others = block.column("others").combine_chunks().take(pa.array([x["line"] for x in rows]))
    texts = [x["kept"].decode("utf-8", "ignore") for x in rows]
    columns = {name: others.field(name) for name in (x.name for x in others.type)}
    columns["text"] = pa.array(texts, pa.string())
    if "n_chars" in columns:
        columns["n_chars"] = pa.array(map(len, texts), pa.int64())
    return pa.table({name: columns[name] for name in schema.names}).cast(schema)


def as_table(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def split_points(texts: DataFrame, buckets: int, documents: int) -> np.ndarray:
    """Splitters by leading bytes, from the anchors of a sample of documents of a fixed size per bucket."""
    schema = arrow("head binary")

    def heads(batches):
        for batch in batches:
            own = Block.of(pa.Table.from_batches([batch]))
            at, _ = anchors(own.data, own.room)
            for i in range(0, len(at), 50_000):
                around = surroundings(own, at[i : i + 50_000 : 8])[0]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in around[:, LEFT : LEFT + GRAM]], pa.binary())], schema=schema)

    share = min(1.0, SAMPLE * buckets / max(1, documents))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    order = F.xxhash64("head", F.monotonically_increasing_id())
    found = sample.mapInArrow(heads, "head binary").orderBy(order).limit(64 * buckets).toArrow()
    values = np.sort(np.array(found.column("head").to_pylist(), dtype=f"S{GRAM}"))
    return np.unique(values[np.arange(1, buckets) * len(values) // buckets]) if len(values) else values


def found_in(plain: DataFrame, blocks: int, buckets: int, documents: int, hot: int) -> DataFrame:
    """The repeated strings of each block. `plain`: doc_id, text and block."""
    splitters = plain.sparkSession.sparkContext.broadcast(split_points(plain, buckets, documents))  # GRAM bytes a bucket
    by_block = plain.groupBy("block")
    grams = by_block.applyInArrow(lambda x: own_grams(x, buckets), GRAMS)
    told = grams.groupBy("bucket").applyInArrow(lambda x: shared_grams(x, hot), TOLD)
    chosen = by_block.cogroup(told.groupBy("block")).applyInArrow(
        lambda x, y: as_table(sent_anchors(x, y, splitters.value, buckets), arrow(ANCHORS)), ANCHORS
    )
    return chosen.groupBy("bucket").applyInArrow(lambda x: as_table(sorted_bucket(x), arrow(FOUND)), FOUND)


def in_blocks(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, text and block of all documents; how many blocks, buckets and documents there are."""
    plain = texts_of(docs)
    size = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-(size.bytes or 0) // BLOCK_BYTES))
    buckets = min(BUCKETS, max(1, -(-(size.bytes or 0) // BUCKET_BYTES)))
    # by the text as well, so that rows without an id, or of one id, don't fill a block
    placed = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return placed, {"blocks": blocks, "buckets": int(buckets), "documents": size.n}


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: its bytes, those that go, their runs, and the digest of what stays.

    All three steps on blocks deal the texts out alike, so Spark shuffles them once and reads them again.
    """
    plain, sizes = in_blocks(docs)
    found = found_in(plain, hot=hot, **sizes)
    return plain.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(digests, RESULT)


def by_row(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """As `without_repeats`, but each row is a document of its own, also where others have its doc_id or none has one.

    Rows of one doc_id come in the order of their digests, those without one before all others.
    """
    repeated = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1")
    if repeated.isEmpty():
        return without_repeats(docs, hot)  # each row is one anyway
    number = free_name(docs, "number")
    rows = marked(docs).orderBy(F.desc("_null"), "_id", "_digest").withColumn("_number", F.monotonically_increasing_id())
    rows = rows.select("_row.*", F.col("_number").alias(number))
    return without_repeats(stored(rows, "numbered"), hot, number)  # written, so that each row keeps its number


def without_repeats(docs: DataFrame, hot: int = HOT, number: str = "doc_id") -> DataFrame:
    """All rows with all their columns, text being what stays, and n_chars, if there, its length.

    Where a cut falls into a character, the rest of the character goes too. A null text becomes an empty one.
    `number`: the column that tells documents apart and gives their order; other than doc_id, it is not returned.
    """
    key = F.col(number).cast("long").alias("doc_id")
    plain, sizes = in_blocks(docs.select(key, "text"))
    found = found_in(plain, hot=hot, **sizes)
    kept = [x for x in docs.columns if x == "doc_id" or x != number]
    others = F.struct(*[F.col(f"`{x}`") for x in kept if x != "text"]).alias("others")
    result = docs.select([F.col(f"`{x}`") for x in kept]).schema
    rows = docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("text"), others)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(sizes["blocks"])).cast("int"))
    schema = to_arrow_schema(result)
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        lambda x, y: cleaned(x, y, schema), result
    )
