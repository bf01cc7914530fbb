"""Words of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Words are told apart by a hash of
62 bits: two polynomials in their bytes modulo a prime, at two fixed places, with a random value for each letter, and
their length. Two given different spans of n bytes share it with a chance of at most (n / 2**31)**2 over the choice of
places, and of about 2**-62 if they have nothing to do with these. Nothing here depends on the process, so every task
gives a word the same hash.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = (1 << 31) - 1
_P = np.uint64(_PRIME)
#: Bytes whose running sums are held at once.
_STEP = 1 << 16
#: Bytes of the words that are hashed byte by byte rather than by running sums; spans at a time for these.
_SHORT = 32
_SPANS = 1 << 15


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo the prime, but that the prime itself and one more may stay."""
    x = (x & _P) + (x >> np.uint64(31))
    return (x & _P) + (x >> np.uint64(31))


class _Polynomial:
    """A place where polynomials are evaluated, with its powers and their inverses, and the letters' values."""

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.base = int(draw.integers(1 << 20, _PRIME))
        self.letters = draw.integers(1, _PRIME, 256).astype(np.uint64)
        self.powers = self._table(self.base)
        self.inverse = pow(self.base, -1, _PRIME)
        self.inverses = self._table(self.inverse)
        #: What each letter adds at each place of a short word.
        self.places = self.letters * self.powers[:_SHORT, None] % _P

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < _STEP:
            out = np.concatenate([out, _fold(out * np.uint64(pow(base, len(out), _PRIME)))])
        return out

    def sums(self, data: np.ndarray, letters: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """The polynomial of all bytes before each place, for some ascending lists of places."""
        value = self.letters[letters]
        out = [np.empty(len(x), dtype=np.uint64) for x in places]
        carry, factor, step = 0, 1, pow(self.base, _STEP, _PRIME)
        running = np.zeros(_STEP + 1, dtype=np.uint64)
        for at in range(0, len(data) + 1, _STEP):
            own = value[data[at : at + _STEP]] * self.powers[: len(data) - at]
            np.cumsum((own & _P) + (own >> np.uint64(31)), out=running[1 : len(own) + 1])
            for where, sums in zip(places, out, strict=True):
                low, high = np.searchsorted(where, (at, at + _STEP))
                here = _fold(running[where[low:high] - at])
                sums[low:high] = _fold(here * np.uint64(factor) + np.uint64(carry))
            carry = (carry + factor * int(running[len(own)])) % _PRIME
            factor = factor * step % _PRIME
        return out

    def values(self, data: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        before, upto = self.sums(data, letters, starts, ends)
        back = pow(self.inverse, _STEP, _PRIME)
        far = [1]
        for _ in range(int(starts[-1]) // _STEP):
            far.append(far[-1] * back % _PRIME)
        shift = _fold(self.inverses[starts % _STEP] * np.array(far, np.uint64)[starts // _STEP])
        x = _fold(_fold(upto + np.uint64(2 * _PRIME) - before) * shift)
        return np.where(x >= _P, x - _P, x)


@cache
def _polynomials(seed: int) -> tuple[_Polynomial, _Polynomial]:
    return _Polynomial(2 * seed + 1), _Polynomial(2 * seed + 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space after each, and where each starts (one more entry for the end)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), starts


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array that ends with a space."""
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)  # what is below 0x09 wraps around
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def hashed(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = _LOWER, seed: int = 0
) -> np.ndarray:
    """A hash of each span, in ascending order; `letters` gives the byte that counts for each, `seed` another hash.

    Besides 8 bytes a span, no more is held than the running sums of a fixed number of bytes, and a copy of long spans
    that are few among the others.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    step = 1 << 18  # spans at a time
    one, two = _polynomials(seed)
    tables = one.places.take(letters, axis=1), two.places.take(letters, axis=1)
    for i in range(0, len(starts), _SPANS):
        a, b = starts[i : i + _SPANS], ends[i : i + _SPANS]
        out[i : i + _SPANS] = _ended(_short(data, a, np.where(b - a > _SHORT, 0, b - a), tables), b - a)
    long = np.flatnonzero(ends - starts > _SHORT)
    for i in range(0, len(long), step):
        some = long[i : i + step]
        a, b = starts[some], ends[some]
        low, high = int(a[0]), int(b[-1])
        own, sizes = data[low:high], b - a
        a, b = a - low, b - low
        if 4 * sizes.sum() < high - low:  # few and far between
            own = np.concatenate([own[x:y] for x, y in zip(a, b, strict=True)])
            b = np.cumsum(sizes)
            a = b - sizes
        x = one.values(own, letters, a, b) << np.uint64(31) | two.values(own, letters, a, b)
        out[some] = _ended(x, sizes)
    return out


def _ended(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(x + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _short(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Both polynomials of spans of at most `_SHORT` bytes, whose terms add up to less than 2**64."""
    order = np.argsort((_SHORT - sizes).astype(np.uint8), kind="stable")
    begin = starts.take(order)
    many = len(sizes) - np.cumsum(np.bincount(sizes, minlength=_SHORT + 1))  # spans of more than so many bytes
    one, two = (np.zeros(len(sizes), dtype=np.uint64) for _ in range(2))
    for k in range(int(sizes.max(initial=0))):
        n = int(many[k])
        letter = data.take(begin[:n] + k).astype(np.intp)
        one[:n] += tables[0][k].take(letter)
        two[:n] += tables[1][k].take(letter)
    out = np.empty(len(sizes), dtype=np.uint64)
    out[order] = one % _P << np.uint64(31) | two % _P
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and how many words each text has."""
    data, begin = joined(texts)
    starts, ends = spans(data)
    counts = np.diff(np.searchsorted(starts, begin))
    return hashed(data, starts, ends), counts


def encoded(texts) -> list[bytes]:
    """Texts of an Arrow column as UTF-8, null as empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
