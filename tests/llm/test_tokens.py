"""Byte-level BPE and packing against the public libraries."""

import gc
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, empty, pairs  # noqa: F401
from eventloom.llm import byte_bpe, packing
from eventloom.llm.chunks import Pieces, distinct_pieces
from eventloom.llm.shared import stored
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


def odd_texts():
    rng = random.Random(2)
    letters = "ab é\n\t 1'sS.，\x85\xa0 日re　\x1c\x00"
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + [" " * 400, "a" * 700, "'s 's"]


def test_ids_equal_the_library(library):
    coder = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, coder.encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids).decode() == text


def test_packing_ids_equal_the_library(tokenizer):
    texts = odd_texts()
    own = packing.encoder(VOCABULARY, PATTERN)
    for text, ids in zip(texts, own.ids([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_replay_of_ranks_out_of_merge_order():
    # "abc" ranks below "ab" and "bc": what a merge brings up goes before others of its rank
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"aa", b"bc", b"aaa", b"abab", b"aabc"]
    replay = byte_bpe.Replay({t: i for i, t in enumerate(tokens)})
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 14))).encode() for _ in range(2000)]
    whole = {t: i for i, t in enumerate(tokens)}
    for word, ids in zip(words, replay.encode(words), strict=True):
        expected = np.array([whole[word]], "<u4").tobytes() if word in whole else replay.one(word)
        assert ids == expected, word


def test_pieces_join_to_the_text_and_the_cache_may_start_anew(library):
    texts = [x.encode() for x in odd_texts()]
    pieces, number, counts = distinct_pieces(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert b"".join(pieces[i] for i in number[at : at + n].tolist()) == text
        at += n
    tight = Pieces(PATTERN, lambda words: [np.array(library.encode_ordinary(w), "<u4").tobytes() for w in words], limit=5)
    for i in range(0, 300, 50):
        part = texts[i : i + 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in tight.ids(part)] == [
            library.encode_ordinary(x.decode()) for x in part
        ]
    assert tight.ids([]) == []


def test_the_garbage_collector_pauses_while_pieces_are_told_apart():
    runs = []
    own = Pieces(PATTERN, lambda words: [b"\0\0\0\0"] * len(words))
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        before = len(runs)
        assert len(own.ids([b" ".join(b"w%d." % k for k in range(50_000))])) == 1
        assert len(runs) == before and gc.isenabled()
    finally:
        gc.callbacks.pop()


def test_encode_documents(awkward, empty, library):
    found = byte_bpe.encode_documents(awkward, RANKS, PATTERN, ids=True).collect()
    expected = Counter()
    for doc, text in pairs(awkward):
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected[doc, len(ids), digest, hashlib.sha256(text.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((*x[:4], tuple(x.ids)) for x in found) == expected
    assert byte_bpe.encode_documents(empty, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("bins", [1, 2, 100])
def test_best_fit_keeps_bins_within_capacity(bins):
    rng = random.Random(bins)
    pack, filled = packing.BestFit(10, bins), defaultdict(int)
    for _ in range(2000):
        n = rng.randint(1, 10)
        number, offset = pack.put(n)
        assert offset == filled[number]
        filled[number] += n
        assert pack.open <= bins
    assert max(filled.values()) <= 10
    assert sorted(filled) == list(range(len(filled)))


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    pack = packing.BestFit(10, 2)
    assert [pack.put(n) for n in (6, 5)] == [(0, 0), (1, 0)]
    assert pack.put(4) == (0, 6)  # leaves bin 0 full, although bin 1 has more room
    assert pack.put(7) == (2, 0)
    assert pack.put(8) == (3, 0)  # both open bins are too full: the fullest, 2, closes
    assert pack.put(3) == (1, 5)
    assert pack.put(2) == (1, 8)


def test_cuts_leave_only_the_first_short():
    assert packing.cuts(1, 4) == [(0, 1)]
    assert packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("share", [250_000, 7])
def test_pack_documents(awkward, empty, tokenizer, share):
    pieces = stored(packing.document_pieces(awkward, VOCABULARY, PATTERN, capacity=64), "pieces")
    rows = packing.pack(pieces, capacity=64, share=share).collect()
    expected = Counter()
    for doc, text in pairs(awkward):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 or min(64, len(ids))
        starts = [0, *range(first, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(x[:5]) for x in rows) == expected
    places = defaultdict(list)
    for x in rows:
        places[x.sequence_id].append((x.offset, x.length))
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 64
    total = sum(x.length for x in rows)
    assert share == 7 or len(places) <= 1.1 * total / 64 + 1
    assert packing.pack_documents(empty, VOCABULARY, PATTERN).count() == 0


def test_added_tokens_have_their_own_ids(spark):
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "a", " b", "'s", "é", "日"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1000)] + ["a <|endoftext|> b"]
    plain = Tokenizer.from_file(VOCABULARY)
    expected = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    found = packing.whole_encoder(VOCABULARY, PATTERN).ids([x.encode() for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == expected
    rows = packing.pack_documents(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), VOCABULARY, PATTERN)
    crcs = {(x.doc_id, x.length, x.ids_crc32) for x in rows.collect()}
    assert crcs == {(i, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(expected)}
