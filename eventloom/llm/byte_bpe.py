"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a block of documents.

The words of a block (matches of the split pattern) are laid out once, each distinct word once, as byte tokens. An
inverted index leads from each mergeable pair, known by the rank of the token it makes, to the positions where it
stands. Merges are then applied in rank order to all words at once, and each merge updates only the entries of its two
neighbours. Blocks have a bounded size and run where their documents are read, so nothing is shuffled.

Null and empty texts have no ids and decode to nothing. Rows are independent: repeated rows and ids give repeated
results, an empty table an empty one, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.chunks import Pieces
from eventloom.llm.shared import blocks, texts_of
from eventloom.llm.words import encoded

BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Replay:
    """Encodes many words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: (left id, right id) to the rank of the token that both make, which is also its id.
        self.pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges at; -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; distinct words save work."""
        whole = [self.ranks.get(word) for word in words]
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        todo = [i for i, rank in enumerate(whole) if rank is None and words[i]]
        if not todo:
            return out
        sizes = np.fromiter((len(words[i]) for i in todo), np.int64, len(todo))
        starts = np.cumsum(sizes) - sizes
        symbols = self.of_byte[np.frombuffer(b"".join([words[i] for i in todo]), dtype=np.uint8)]
        odd = self._replay(symbols, starts, sizes)
        alive = symbols >= 0
        kept = symbols[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(alive.astype(np.int64), starts))).tolist()
        for i, start, end in zip(todo, [0, *ends], ends, strict=False):
            out[i] = kept[start:end]
        for at in np.unique(np.searchsorted(starts, odd, side="right") - 1).tolist():
            out[todo[at]] = self.one(words[todo[at]])
        return out

    def one(self, word: bytes) -> bytes:
        """A word on its own: always the leftmost pair of the lowest rank."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            rank, at = min((self.pairs.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))  # noqa: B905
            if rank == 1 << 40:
                break
            ids[at : at + 2] = [rank]
        return np.array(ids, "<u4").tobytes()

    def _replay(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Apply all merges in place; a token that a merge swallowed becomes -1.

        Returns positions in words where a merge brought up a pair of a lower rank, which has to go before others of
        the rank just done; vocabularies in merge order have none, and such words are encoded on their own.
        """
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + sizes - 1] = -1
        before[starts] = -1
        current = np.full(n, -1, dtype=np.int64)  # the rank of the pair that starts at each position
        first = np.flatnonzero(after >= 0)
        current[first] = self.rank(symbols[first], symbols[first + 1])
        first = first[current[first] >= 0]
        first = first[np.argsort(current[first], kind="stable")]
        cuts = np.flatnonzero(np.diff(current[first], prepend=-1))
        index: dict[int, list[np.ndarray]] = {
            int(current[x[0]]): [x] for x in np.split(first, cuts[1:]) if len(x)
        }
        queue = list(index)
        heapq.heapify(queue)
        odd = [np.empty(0, dtype=np.int64)]
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            at = np.sort(np.concatenate(places)) if len(places) > 1 else places[0]
            at = at[current[at] == rank]
            if not len(at):
                continue
            then = after[at]
            if len(at) > 1 and (then[:-1] == at[1:]).any():  # overlapping places: the leftmost of each run merges
                at = at[self._leftmost(at, then)]
                then = after[at]
            beyond = after[then]
            symbols[at], symbols[then], current[then] = rank, -1, -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            current[at] = -1
            right = at[inner]
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([left, right])
            if not len(touched):
                continue
            new = self.rank(symbols[touched], symbols[after[touched]])
            current[touched] = new
            some = new >= 0
            if not some.any():
                continue
            touched, new = touched[some], new[some]
            odd.append(touched[new < rank])
            order = np.argsort(new, kind="stable")
            touched, new = touched[order], new[order]
            cuts = np.flatnonzero(np.diff(new, prepend=-1))
            for value, part in zip(new[cuts].tolist(), np.split(touched, cuts[1:]), strict=True):
                if value in index:
                    index[value].append(part)
                else:
                    index[value] = [part]
                    heapq.heappush(queue, value)
        return np.concatenate(odd)

    @staticmethod
    def _leftmost(at: np.ndarray, then: np.ndarray) -> list[int]:
        kept, swallowed = [], -1
        for i, (a, b) in enumerate(zip(at.tolist(), then.tolist(), strict=True)):
            if a != swallowed:
                kept.append(i)
                swallowed = b
        return kept


class Coder:
    """Ids of whole texts, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        replay = Replay(ranks)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.pieces = Pieces(pattern, lambda words: replay.encode([w.encode("utf-8", "replace") for w in words]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return self.pieces.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder for each Python worker; its tables are read-only and its cache bounded."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Per document: the number of tokens and the digests of the ids and of their decoding; `ids` adds the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for block in blocks(batches, BLOCK_BYTES):
            coded = own.encode(encoded(block.column("text")))
            columns = [
                block.column("doc_id").combine_chunks(),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in coded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in coded], pa.list_(pa.int64())))
                names.append("ids")
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)

    return texts_of(docs).mapInArrow(run, SCHEMA + (", ids array<long>" if ids else ""))
