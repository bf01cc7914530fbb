"""Texts cut at single spaces, so that equal pieces of a block are tokenized once.

The public split pattern never joins what stands on both sides of a space that a non-space follows: such a space
opens a match of its own or is its first character. A text is therefore a run of pieces, of which all but the first
begin with a space, and its ids are those of its pieces in a row.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np

from eventloom.llm.words import mix

#: Bytes that are no white space and begin none in UTF-8: after a space, these open a piece.
_OPENS = np.ones(256, dtype=bool)
_OPENS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_AS_IS = np.arange(256, dtype=np.uint8)
#: The first 0 to 8 bytes of a little-endian number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9FB21C651E98DF25)
#: Longer pieces and words are not cached.
_CACHED = 256


def keys(whole: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each piece, for this process, and its first and second eight bytes; `whole` has 16 more bytes behind."""
    words = np.ndarray(len(whole) - 7, dtype="<u8", buffer=whole, strides=(1,))
    one = words[starts] & _MASK[np.minimum(lengths, 8)]
    two = words[starts + 8] & _MASK[np.clip(lengths - 8, 0, 8)]
    key = mix(mix(one + lengths.astype(np.uint64) * _ODD) + two * _ODD)
    long = np.flatnonzero(lengths > 16)
    if len(long):
        pairs = zip(starts[long].tolist(), (starts + lengths)[long].tolist(), strict=True)
        key[long] ^= np.fromiter((hash(whole[a:b]) for a, b in pairs), np.int64, len(long)).view(np.uint64)
    return key, one, two


def distinct_pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of some texts, the piece number of each place, and how many places each text has.

    Pieces of the same hash are compared with their first one; should any differ, pieces are told apart by their bytes
    alone.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    size = int(lengths.sum())
    whole = b"".join([*texts, bytes(16)])
    data = np.frombuffer(whole, dtype=np.uint8, count=size)
    opens = np.zeros(size, dtype=bool)
    opens[:-1] = (data[:-1] == 0x20) & _OPENS[data[1:]]
    opens[begin[lengths > 0]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], size)[: len(starts)]
    counts = np.diff(np.searchsorted(starts, np.append(begin, size)))
    each = ends - starts
    key, head, next_ = keys(whole, starts, each)
    order = np.argsort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    first = one[number]
    same = all((x == x[first]).all() for x in (each, head, next_))
    long = np.flatnonzero((each > 16) & (first != np.arange(len(first)))) if same else ()
    if same and all(whole[starts[k] : ends[k]] == whole[starts[f] : ends[f]] for k, f in zip(long, first[long], strict=True)):
        return [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], number, counts
    numbers: dict[bytes, int] = {}
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        number[k] = numbers.setdefault(whole[a:b], len(numbers))
    return list(numbers), number, counts


class Pieces:
    """The ids of texts as little-endian 32-bit integers, block by block.

    New pieces of a block are split into words by the public pattern; `encode` gets the distinct new words and returns
    their ids. Pieces and words of up to 256 bytes are cached. Once the caches hold about `limit` bytes, they start anew;
    they only save work and never change a result.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], limit: int = 96 << 20):
        import regex

        self._split, self.encode, self.limit = regex.compile(pattern).findall, encode, limit
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def split(self, piece: str) -> list[str]:
        """The matches of the pattern; a space and ASCII letters, alone or before a comma or stop, need no search."""
        if piece.isascii() and piece[:1] == " ":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ",." and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self._split(piece)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text.

        The garbage collector pauses meanwhile: it would visit millions of short lists again and again, none in a cycle.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        distinct, number, counts = distinct_pieces(texts)
        if self.held > self.limit:
            self.pieces, self.words, self.held = {}, {}, 0
        pieces, words = {}, {}  # those of this block that are new
        fresh = [x for x in distinct if x not in self.pieces]
        split = [self.split(x.decode("utf-8", "replace")) for x in fresh]
        new = list({w for x in split for w in x if w not in self.words})
        words.update(zip(new, self.encode(new), strict=True))
        known = self.words
        for piece, own in zip(fresh, split, strict=True):
            pieces[piece] = b"".join([words[w] if w in words else known[w] for w in own])
        coded = [pieces[x] if x in pieces else self.pieces[x] for x in distinct]
        for cache, found in ((self.pieces, pieces), (self.words, words)):
            for x, ids in found.items():
                if len(x) <= _CACHED:
                    cache[x] = ids
                    self.held += len(x) + len(ids) + 200
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        firsts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(coded), dtype="<u4")
        each = sizes[number]
        upto = np.cumsum(each)
        at = np.repeat(firsts[number] - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)
        flat = table[at].tobytes()
        cuts = np.append(0, upto)[np.append(0, np.cumsum(counts))] * 4
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
