"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no neighbouring word
extends keeping the period. All runs of a document are found, and of each run all but its first q words are dropped.

* Candidates come from a harmonic grid: for every period q the words 0, q, 2q, ... of each document. A run of 4 * q words
  holds four grid places in a row, so places whose words differ from the next three are no candidates. Over all q these
  are n * ln(n) places for n words.
* `Grammar`: recompression turns the documents of a block into a run-length grammar, level by level: blocks of one symbol
  become a symbol, then pairs of a left and a right symbol do, by a fixed hash that splits the alphabet. Equal stretches
  are parsed alike but for their ends. `extend` answers longest common extensions of two places, forwards or backwards,
  by the largest symbols that begin (or end) at both; repeated symbols are passed by count.
* A candidate's two extensions give the run's exact bounds. Multiples of a run's period give the same bounds, of which the
  smallest period stays.

Only documents with candidates enter a grammar. Words are told apart by their bytes. Each document is worked on where it
is read, so nothing is shuffled; blocks have a bounded size, and of a longer text no more is held than its words' numbers,
its distinct words and one grammar.

Null and empty texts, and those of white space, have no words and no runs. Rows are independent: repeated rows and ids,
or a null doc_id, give a result each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.shared import blocks, texts_of
from eventloom.llm.words import encoded, mix

BLOCK_BYTES = 4 << 20
#: Bytes of a text that are split into words at once, and words that are joined at once.
PART = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


class Lexicon:
    """Numbers of words, in order of appearance, and their bytes."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)

    def numbers(self, text: bytes) -> np.ndarray:
        """The number of every word of a text, which is split part by part."""
        out, at = [np.empty(0, np.int64)], 0
        while at < len(text):
            end = at + PART
            if end < len(text):
                gap = SPACE.search(text, end)
                end = gap.start() if gap else len(text)
            words = text[at:end].split()
            out.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            at = end
        return np.concatenate(out)

    def names(self) -> list[bytes]:
        return list(self.number)


class Grammar:
    """A run-length grammar of some sequences, by recompression.

    Place p of the `places` is a bound between symbols: that of sequence d before its word i is `first[d] + i`, and one
    more stands after its last word. For each place, one entry per level up to the highest at which it is still a bound:
    the symbols right and left of it, and how often each is repeated from there. `size` has a symbol's words.
    """

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.places = int((lengths + 1).sum())
        words = np.concatenate([np.empty(0, np.int64), *sequences])
        owner = np.repeat(np.arange(len(sequences)), lengths)
        begin = np.arange(len(words)) + owner  # the place before each symbol
        known, symbol = np.unique(words, return_inverse=True)
        size = [np.ones(len(known), np.int64)]
        many = len(known)
        levels = []
        blocks_next = True
        while True:
            levels.append((begin, symbol, owner, blocks_next))
            if len(symbol) <= len(sequences):
                break
            same = np.zeros(len(symbol), dtype=bool)  # whether a symbol belongs to the one before it
            inside = owner[1:] == owner[:-1]
            if blocks_next:
                same[1:] = inside & (symbol[1:] == symbol[:-1])
            else:
                side = mix(symbol.astype(np.uint64) + np.uint64(len(levels) << 40)) & np.uint64(1)
                same[1:] = inside & (side[:-1] == 0) & (side[1:] == 1)
            blocks_next = not blocks_next
            head = np.flatnonzero(~same)
            members = np.diff(np.append(head, len(symbol)))
            new = symbol[head].copy()
            merged = np.flatnonzero(members > 1)
            if len(merged):
                left = symbol[head[merged]]
                # a block is told by its symbol and count, a pair by its two symbols
                right = symbol[head[merged] + 1] if blocks_next else members[merged]
                made, which = np.unique(np.stack([left, right]), axis=1, return_inverse=True)
                sizes = np.concatenate(size)
                new[merged] = many + which.ravel()
                size.append(sizes[made[0]] + sizes[made[1]] if blocks_next else sizes[made[0]] * made[1])
                many += made.shape[1]
            begin, symbol, owner = begin[head], new, owner[head]
        self.size = np.concatenate(size)
        ends = self.first + lengths
        self.top = np.zeros(self.places, dtype=np.int64)
        for level, (begin, _, _, _) in enumerate(levels):
            self.top[begin] = level
        self.top[ends] = len(levels) - 1
        self.entry = np.cumsum(self.top + 1) - self.top - 1
        total = int((self.top + 1).sum())
        # -1 to the right of a sequence and -2 to the left of it match nothing
        self.right, self.left = np.full(total, -1, np.int64), np.full(total, -2, np.int64)
        self.right_count, self.left_count = np.ones(total, np.int64), np.ones(total, np.int64)
        for level, (begin, symbol, owner, counted) in enumerate(levels):
            if not len(symbol):
                continue
            after = np.append(begin[1:], 0)
            last = np.append(owner[1:] != owner[:-1], True)
            after[last] = ends[owner[last]]
            at, then = self.entry[begin] + level, self.entry[after] + level
            self.right[at], self.left[then] = symbol, symbol
            if counted:
                fresh = np.append(True, (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1]))
                heads = np.flatnonzero(fresh)
                members = np.diff(np.append(heads, len(symbol)))
                since = np.arange(len(symbol)) - np.repeat(heads, members)
                self.left_count[then] = since + 1
                self.right_count[at] = np.repeat(members, members) - since

    def extend(self, one: np.ndarray, two: np.ndarray, forwards: bool) -> np.ndarray:
        """How many words two different places of a sequence have in common, to the right or to the left."""
        side, counts, step = (self.right, self.right_count, 1) if forwards else (self.left, self.left_count, -1)
        out = np.zeros(len(one), dtype=np.int64)
        who = np.arange(len(one))
        a, b = one.copy(), two.copy()
        level = np.minimum(self.top[a], self.top[b])
        while len(who):
            x, y = self.entry[a] + level, self.entry[b] + level
            same = side[x] == side[y]
            times = np.minimum(counts[x], counts[y])
            move = np.where(same, self.size[np.where(same, side[x], 0)] * times, 0)
            out[who] += move
            a, b = a + step * move, b + step * move
            level = np.where(same, np.minimum(self.top[a], self.top[b]), level - 1)
            on = level >= 0
            who, a, b, level = who[on], a[on], b[on], level[on]
        return out


def candidates(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequence, place and period of every grid place whose word the next three of its grid repeat, part by part."""
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    lengths = np.array([len(sequences[k]) for k in order], dtype=np.int64)
    data = np.concatenate([np.empty(0, np.int64), *[sequences[k] for k in order]])
    first = np.cumsum(lengths) - lengths
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, enough = 0, max(PART, len(data))
    long = int((lengths >= 6).sum())
    for q in range(1, int(lengths[0]) // 4 + 1 if len(lengths) else 0):
        while long and lengths[long - 1] < 4 * q:
            long -= 1
        if long == 1:
            at = np.arange(0, lengths[0] - 3 * q, q)
            text = np.zeros(len(at), dtype=np.int64)
        else:
            each = -(-(lengths[:long] - 3 * q) // q)
            text = np.repeat(np.arange(long), each)
            at = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * q
        keep = data[at] == data[at + q]
        at, text = at[keep], text[keep]
        if not len(at):
            continue
        keep = (data[at] == data[at + 2 * q]) & (data[at] == data[at + 3 * q])
        at, text = at[keep], text[keep]
        for more in {1, q // 2, q - 1} if q > 1 else ():  # the two periods behind a grid place are equal as well
            keep = (data[at + more] == data[at + q + more]) & (data[at + more] == data[at + 2 * q + more])
            at, text = at[keep], text[keep]
        if len(at):
            found.append((order[text], at - first[text], np.full(len(at), q, np.int64)))
            held += len(at)
        if held >= enough:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
            found, held = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def verified(sequences: list[np.ndarray], text: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (sequence, start, length, period) of the runs that some candidates lie in."""
    used, own = np.unique(text, return_inverse=True)
    grammar = Grammar([sequences[k] for k in used])
    here = grammar.first[own] + at
    forth = grammar.extend(here, here + period, forwards=True)
    back = grammar.extend(here, here + period, forwards=False)
    length = back + period + forth
    good = length >= np.maximum(6, 4 * period)
    return distinct(np.stack([text[good], (at - back)[good], length[good], period[good]], 1))


def distinct(rows: np.ndarray) -> np.ndarray:
    """Of runs with the same bounds, that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def runs_of(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence its runs as rows (start, length, period), by start and then period."""
    out = [np.empty((0, 3), np.int64)] * len(sequences)
    rows = np.empty((0, 4), np.int64)
    for part in candidates(sequences):
        rows = distinct(np.concatenate([rows, verified(sequences, *part)]))
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(sequences) + 1))
    for k in np.unique(rows[:, 0]).tolist():
        out[k] = rows[cuts[k] : cuts[k + 1], 1:]
    return out


def best(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length by period; of equal ones that of the smallest start and then period."""
    top = None
    for start, length, period in runs.tolist():
        if top is None or length * top[2] > top[1] * period:
            top = (start, length, period)
    return top


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with a tail made periodic, by a fixed rule: in a tenth of the documents, chosen by their id."""
    if doc_id is None or not len(words):
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return words[at]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stands in a run after that run's first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) > 0


def joined(words: np.ndarray, names: list[bytes]) -> Iterator[bytes]:
    """The words with a space between them, part by part."""
    for i in range(0, len(words), PART):
        yield (b" " if i else b"") + b" ".join([names[k] for k in words[i : i + PART].tolist()])


def block_runs(texts: list[bytes], doc_ids: list[int | None], plant: bool):
    """The distinct words of some texts; each text's words as numbers, after planting if asked for, and its runs."""
    lexicon = Lexicon()
    words = [lexicon.numbers(x) for x in texts]
    if plant:
        words = [planted(x, k) for x, k in zip(words, doc_ids, strict=True)]
    return lexicon.names(), words, runs_of(words)


def run_report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per document: how many runs, the one of the greatest exponent, and digests of all runs and of what is left.

    With `plant`, the words of a tenth of the documents are first made periodic (`planted`).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids = block.column("doc_id").to_pylist()
            names, words, runs = block_runs(encoded(block.column("text")), ids, plant)
            tops, listed, left = [], [], []
            for own, found in zip(words, runs, strict=True):
                top = best(found)
                tops.append((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2]))
                listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found.tolist()).encode()).hexdigest())
                digest = hashlib.sha256()
                for part in joined(own[~dropped(len(own), found)] if len(found) else own, names):
                    digest.update(part)
                left.append(digest.hexdigest())
            start, length, period, exponent = zip(*tops, strict=True) if tops else ((),) * 4
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(map(len, runs), pa.int64()),
                *(pa.array(x, pa.int64()) for x in (start, length, period, exponent)),
                pa.array(listed, pa.string()),
                pa.array(left, pa.string()),
            ]
            names_ = [x.split()[0] for x in SCHEMA.split(",")]
            yield from pa.Table.from_arrays(columns, names_).to_batches(max_chunksize=10_000)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def all_runs(docs: DataFrame) -> DataFrame:
    """Every run: doc_id, start, length and period, counted in words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids = block.column("doc_id").to_pylist()
            _, _, runs = block_runs(encoded(block.column("text")), ids, plant=False)
            rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
            owner = pa.array(np.repeat(np.arange(len(runs)), [len(x) for x in runs]))
            columns = [block.column("doc_id").combine_chunks().take(owner), *(pa.array(rows[:, k]) for k in range(3))]
            table = pa.Table.from_arrays(columns, ["doc_id", "start", "length", "period"])
            yield from table.to_batches(max_chunksize=20_000)

    return texts_of(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """Per document the text without its repeats: doc_id and the words that are left, a space between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            ids = block.column("doc_id").to_pylist()
            names, words, runs = block_runs(encoded(block.column("text")), ids, plant=False)
            left = [
                b"".join(joined(own[~dropped(len(own), found)], names)).decode("utf-8", "replace")
                for own, found in zip(words, runs, strict=True)
            ]
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(left, pa.string())})
            yield from table.to_batches(max_chunksize=2_000)

    return texts_of(docs).mapInArrow(run, "doc_id long, text string")
