"""Array steps of the language model and of the hash of words, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from eventloom.llm import language_model, words


def plain_hash(span, letters, seed=0):
    """The hash of one span by plain integers."""
    prime = 2**31 - 1
    one, two = (
        sum(int(p.letters[letters[c]]) * pow(p.base, k, prime) for k, c in enumerate(span)) % prime for p in words._polynomials(seed)
    )
    x = ((one << 31 | two) + len(span) * 0xD6E8FEB86659FD93) % (1 << 64)
    return int(words.mix(np.array([x], np.uint64))[0])


@pytest.mark.parametrize("sizes", [(1, 2, 5, 31, 32), (33, 40, 100), (1, 4, 32, 33, 34, 300), (70_000, 3)])
def test_hash_of_short_and_long_words(sizes):
    rng = random.Random(5)
    texts = [b" ".join(bytes(rng.randrange(33, 256) for _ in range(rng.choice(sizes))) for _ in range(12)) for _ in range(3)]
    texts += [b"", b"plain words " * 2000 + b"A" * 50]  # one long word far from the others
    found, counts = words.words(texts)
    expected = [[plain_hash(w, words._LOWER) for w in t.lower().split(b" ") if w] for t in texts[:3]]
    assert counts[:3].tolist() == list(map(len, expected))
    assert found[: counts[:3].sum()].tolist() == [x for own in expected for x in own]
    assert found[-1] == plain_hash(b"a" * 50, words._LOWER) and found[-2] == plain_hash(b"words", words._LOWER)


def test_spaces():
    data = np.array([*range(256), 0x20], dtype=np.uint8)
    starts, ends = words.spans(data)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 9), (14, 32), (33, 256)]


@pytest.mark.parametrize("many", [0, 1, 5, 4000])
def test_places_of_hashes(many):
    rng = np.random.default_rng(2)
    some = rng.integers(0, 1 << 64, 6000, dtype=np.uint64)
    some[-3:] = 0, (1 << 64) - 1, 1 << 40
    known = np.unique(np.concatenate([some[:many], some[many : many + 1] + np.uint64(1)])) if many else some[:0]
    place = {int(x): k for k, x in enumerate(known)}
    assert language_model.Places(known).of(some).tolist() == [place.get(int(x), len(known)) for x in some]


def test_sums_of_shared_rows():
    rng = np.random.default_rng(3)
    own = rng.choice([5, 7, 8, 9, 70, 200_000, *range(100, 600)], 900)
    p = rng.normal(size=(900, language_model.WIDTH)).astype(np.float32)
    expected = defaultdict(float)
    for row, line in zip(own.tolist(), p.astype(np.float64), strict=True):
        expected[row] = expected[row] + line
    rows, sums = language_model.summed(p, own)
    assert rows.tolist() == sorted(expected)
    assert np.allclose(sums, [expected[x] for x in rows.tolist()], rtol=1e-6, atol=1e-7)


def test_an_update_by_brute_force():
    """Weights after one update, of places that share rows within a feature and between the two."""
    rng = np.random.default_rng(4)
    weights = language_model.in_lines(rng.normal(size=(40, 16)).astype(np.float32))
    squares, used, before = np.ones(40, np.float32), np.zeros(40, bool), weights.copy()
    prior, line, truth = rng.normal(size=(3, 16)).astype(np.float32), rng.integers(0, 3, 50), rng.integers(0, 16, 50)
    rows = [rng.integers(0, 20, 50), rng.integers(10, 30, 50)]
    language_model.learn(weights, squares, used, prior, line, rows, truth)
    z = prior[line].astype(float) + before[rows[0]] + before[rows[1]]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(16)[truth]
    expected, past = before.astype(float), np.ones(40)
    for own in rows:
        slope = np.zeros((40, 16))
        np.add.at(slope, own, p)
        past += (slope**2).sum(axis=1)
        expected -= slope * (language_model.RATE / np.sqrt(past))[:, None]
    assert np.allclose(weights, expected, atol=1e-5) and np.allclose(squares, past, rtol=1e-5)
    assert used.nonzero()[0].tolist() == sorted({*rows[0].tolist(), *rows[1].tolist()})
    assert weights.ctypes.data % 64 == 0


def test_a_block_is_hashed_once_for_its_scores(monkeypatch):
    calls, plain = [], language_model.tokens

    def counted(texts):
        calls.append(len(texts))
        return plain(texts)

    monkeypatch.setattr(language_model, "tokens", counted)
    own = language_model.Tree(
        3, 1, 1.0, 2, np.zeros(0, np.uint64), np.array([0]), np.zeros((1, 1), int), np.zeros((1, 1), int), np.zeros((1, 16), np.float32)
    )
    known = {"word": np.zeros(0, np.uint64), "n": np.zeros(0, int), "leaf_n": np.zeros(0, int)}
    out = language_model.score_block([b"a b", b""], known, np.zeros((1 << own.bits, 16), np.float32), own)
    assert calls == [2] and out["n_tokens"].tolist() == [3, 1] and out["n_known"].tolist() == [0, 0]
    assert out["score"] == pytest.approx([-6 * np.log10(16), -2 * np.log10(16)])
