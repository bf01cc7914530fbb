"""Texts that hashes modulo a power of two can't tell apart, and user columns of any name, through the public functions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from eventloom.llm import (
    byte_bpe,
    chunks,
    exact_dedup,
    jaccard,
    language_model,
    packing,
    sentence_spans,
    suffix_dedup,
    words,
)
from eventloom.llm.chunks import Pieces, distinct_pieces
from tokenizers import Tokenizer

SWAP = str.maketrans("ab", "ba")


def pair(steps):
    """A Thue-Morse string and its complement."""
    text = "a"
    for _ in range(steps):
        text += text.translate(SWAP)
    return text, text.translate(SWAP)


PAIRS = [x for steps in (10, 11, 12) for x in pair(steps)]


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame(list(enumerate(PAIRS)), "doc_id long, text string").coalesce(1)


def test_hashes_tell_them_apart():
    text = " ".join(PAIRS) + " "
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = words.spans(data)
    for seed in (0, 1):
        assert len(set(words.hashed(data, starts, ends, seed=seed).tolist())) == len(PAIRS)


def test_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(2)
    own = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*range(1, 60), 70_000, 140_000]]
    data, _ = words.joined([own[k] for k in rng.integers(0, len(own), 400).tolist()])
    starts, ends = words.spans(data)
    found = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), words.hashed(data, starts, ends).tolist(), strict=True):
        assert found.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(found.values())) == len(found)


def test_byte_bpe(twins):
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    found = byte_bpe.encode_documents(
        twins, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True
    ).collect()
    for x in found:
        assert list(x.ids) == library.encode_ordinary(PAIRS[x.doc_id])
        assert x.decoded_sha256 == hashlib.sha256(PAIRS[x.doc_id].encode()).hexdigest()


def test_packing(twins):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    crcs = {}
    for k, text in enumerate(PAIRS):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(2048, len(ids))
        for a, b in zip([0, *range(first, len(ids), 2048)], [first, *range(first + 2048, len(ids) + 1, 2048)], strict=True):
            crcs[k, a] = zlib.crc32(ids[a:b].tobytes())
    rows = packing.pack_documents(twins, path, public_tokenizers.PATTERN).collect()
    assert {(x.doc_id, x.start): x.ids_crc32 for x in rows} == crcs


def test_jaccard(twins):
    assert sorted(x.component_id for x in jaccard.near_duplicates(twins).collect()) == list(range(len(PAIRS)))


def test_sentence_spans(spark):
    texts = [f"{x}. {x} and so on with a few more words to make a long run here." for x in PAIRS]
    texts.append(texts[0])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = {x.doc_id: x.n_removed for x in sentence_spans.without_repeats(frame).collect()}
    assert removed == {k: 0 for k in range(len(PAIRS))} | {len(PAIRS): 2}


def test_language_model(spark):
    texts = [f"{x} {y}" for x in PAIRS for y in PAIRS][:30]
    rows = list(enumerate(texts))
    training = Counter()
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 10:
            training.update([*text.split(), None])
    total, distinct = sum(training.values()), len(training)
    for x in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = [training[w] for w in [*texts[x.doc_id].split(), None]]
        assert x.n_known == sum(n > 0 for n in own)
        assert x.base_score == pytest.approx(sum(np.log10((n + 0.1) / (total + 0.1 * (distinct + 1))) for n in own))


def test_pieces_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    long = b"0123456789abcdef"
    texts = [b"one two", b"two one one", b"three two", b"", b" ".join([long + b"gh", long + b"ij", long + b"gh", long])]
    want = distinct_pieces(texts)
    real = chunks.keys
    monkeypatch.setattr(chunks, "keys", lambda *given: (np.zeros(len(given[1]), np.uint64), *real(*given)[1:]))
    found = distinct_pieces(texts)
    for pieces, number, counts in (want, found):
        at = np.cumsum(counts) - counts
        assert [b"".join(pieces[k] for k in number[a : a + n]) for a, n in zip(at, counts, strict=True)] == texts


def test_the_cache_is_bounded_by_bytes():
    pieces = Pieces(public_tokenizers.PATTERN, lambda some: [b"\0\0\0\0" * len(w) for w in some], limit=100_000)
    for k in range(200):
        texts = [f"{'日本' * 1000}{k} {'x' * 50}{k} {k}{j}".encode() for j in range(20)]
        assert [len(x) for x in pieces.ids(texts)] == [4 * len(t.decode()) for t in texts]
        assert sum(len(a) + len(b) for cache in (pieces.pieces, pieces.words) for a, b in cache.items()) < 300_000


NAMES = "doc_id long, text string, _id string, _NULL string, _digest string, _row string, _number string, number string, others string, first string"


def test_user_columns_of_any_name_stay(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, text if k < 3 else f"{text} {k} " * 2, *[f"{k}{c}" for c in "abcdefgh"]) for k in range(6)]
    rows += [rows[4], (None, text, *"abcdefgh")]
    docs = spark.createDataFrame(rows, NAMES)
    given = {(x[0], *x[2:]) for x in rows}
    for stage in (exact_dedup.without_copies, jaccard.one_of_each, suffix_dedup.by_row, suffix_dedup.without_repeats):
        result = stage(docs)
        assert result.schema == docs.schema
        found = [tuple(x) for x in result.collect()]
        assert found
        assert {(x[0], *x[2:]) for x in found} <= given


def test_marks_are_no_columns_of_the_result(spark):
    docs = spark.createDataFrame([(1, "a", "z")], "doc_id long, text string, _id string")
    assert [tuple(x) for x in exact_dedup.without_copies(docs).collect()] == [(1, "a", "z")]
