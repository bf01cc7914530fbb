"""Top-k search against brute force; learned models by their counts, their normalisation and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from eventloom.llm import labelled, language_model, quality, top_k, toxicity
from eventloom.llm.subword import Shape, Training, train
from eventloom.llm.words import mix
from helpers import awkward, empty, pairs  # noqa: F401


def top_brute(rows, every, k, scale):
    vectors = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for q, a in vectors:
        if q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in vectors if c != q]
            for rank, (score, c) in enumerate(sorted(scores)[:k], 1):
                out[q, rank, c, -score] += 1
    return out


@pytest.mark.parametrize(("block", "queries"), [(8192, 2048), (40, 4)])
def test_top_k(spark, block, queries):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12) * rng.choice([0.1, 1, 3]))]) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, [float("nan")] * 12), (402, [None] * 12), (403, [float("inf")] * 12), (404, [])]
    rows += [(405, [0.5, 2.0]), (406, [0.0] * 12), (None, [1.0] * 12), (407, [1e4] * 12), (408, [-1e4] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = top_k.top_k(frame.selectExpr("*", "1 AS block", "2 AS norm"), lambda x: x % 10 == 0, block=block, queries=queries)
    assert Counter(map(tuple, found.collect())) == top_brute(rows, 10, 5, 256)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k.top_k(spark.createDataFrame([], schema), lambda x: x % 2 == 0).count() == 0
    found = top_k.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), lambda x: x % 2 == 0)
    assert [tuple(x) for x in found.collect()] == [(0, 1, 1, 256 * 512)]


def base_brute(rows):
    split = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for own, h in zip(split, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    return {
        (d, h, len(own), sum(counts[w] > 0 for w in own), n): sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        for (d, _), own, h in zip(rows, split, held, strict=True)
    }


def test_base_scores(awkward, empty):
    found = language_model.score_documents(awkward).collect()
    expected = base_brute(pairs(awkward))
    assert {tuple(x[:5]) for x in found} == expected.keys() and len(found) == awkward.count()
    for x in found:
        assert x.base_score == pytest.approx(expected[tuple(x[:5])], abs=1e-9)
        assert x.score < 0 and math.isfinite(x.score)
    assert language_model.score_documents(empty).count() == 0


def model(spark, texts, monkeypatch, frequent=20):
    """A tree and weights over some texts, few of whose tokens are frequent."""
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = language_model.token_counts(docs).persist()
    own = language_model.tree(counts)
    return docs, counts, own, language_model.trained(docs, own)


def texts_of_few_words(many):
    rng = random.Random(3)
    words = [f"k{i}" for i in range(400)]
    return [" ".join(words[min(int(rng.paretovariate(0.7)) - 1, 399)] for _ in range(rng.randint(0, 60))) for _ in range(many)]


def plain_path(own, token):
    """Nodes and branches of a token, by plain integers."""
    place = {int(x): k for k, x in enumerate(own.frequent)}.get(token)
    line = len(own.frequent) if place is None else place
    path = [(int(own.node[line, k]), int(own.branch[line, k]), int(own.node[line, k])) for k in range(int(own.depth[line]))]
    if place is None:
        for k in range(own.digits):
            prefix, digit = token >> (64 - 4 * k), token >> (60 - 4 * k) & 15
            path.append(((prefix * int(language_model.ODD) + k + (1 << 40)) % (1 << 64), digit, len(own.prior) - 1))
    return path


def plain_chances(own, weights, node, line, past):
    """The softmax of a node after two tokens."""
    one, two = past
    kinds = [one, two * int(language_model.ODD) % (1 << 64), node]
    *mixed, at = [int(x) for x in mix(np.array(kinds, np.uint64))]
    z = own.prior[line].astype(float)
    for kind in mixed:
        row = ((kind ^ at) * int(language_model.ODD) % (1 << 64)) >> (64 - own.bits)
        z = z + weights[row]
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_by_brute_force(spark, monkeypatch):
    docs, counts, own, weights = model(spark, texts_of_few_words(150), monkeypatch)
    assert own.digits >= 2 and np.abs(weights).max() > 0.1
    n = {x.word % (1 << 64): x.n for x in counts.collect()}
    frequent, digits = {int(x) for x in own.frequent}, own.digits
    leaves = Counter()
    for token, k in n.items():
        if token not in frequent:
            leaves[token >> (64 - 4 * digits)] += k
    found = language_model.scored(docs, language_model.shares(counts, own), own, weights).collect()
    assert len(found) == 150
    texts = dict(map(tuple, docs.collect()))
    for x in found[:40]:
        token = [int(t) for t in language_model.tokens([texts[x.doc_id].encode()])[0]]
        score, start = 0.0, int(language_model.START)
        for k, t in enumerate(token):
            past = (token[k - 1] if k else start, token[k - 2] if k > 1 else start)
            for node, branch, line in plain_path(own, t):
                score += math.log10(plain_chances(own, weights, node, line, past)[branch])
            if t not in frequent:
                known = t in n
                score += math.log10((1 - own.unknown) * n[t] / leaves[t >> (64 - 4 * digits)] if known else own.unknown)
        assert x.score == pytest.approx(score, rel=1e-4, abs=1e-3)


def test_model_is_a_distribution(spark, monkeypatch):
    """After any context the chances of all known tokens, of one unknown token a leaf, and of empty leaves sum to 1."""
    _, counts, own, weights = model(spark, texts_of_few_words(60), monkeypatch)
    n = {x.word % (1 << 64): x.n for x in counts.collect()}
    frequent = {int(x) for x in own.frequent}
    leaves = Counter()
    for token, k in n.items():
        if token not in frequent:
            leaves[token >> (64 - 4 * own.digits)] += k

    def chance(token, past):
        out = 1.0
        for node, branch, line in plain_path(own, token):
            out *= plain_chances(own, weights, node, line, past)[branch]
        return out

    for past in ((7, 9), (int(own.frequent[0]), int(own.frequent[1]))):
        total = sum(chance(t, past) for t in frequent)
        for leaf in range(16**own.digits):
            mass = chance(leaf << (64 - 4 * own.digits), past)
            tokens = [t for t in n if t not in frequent and t >> (64 - 4 * own.digits) == leaf]
            total += sum(mass * (1 - own.unknown) * n[t] / leaves[leaf] for t in tokens)
            total += mass * (own.unknown if tokens else 1)
        assert total == pytest.approx(1, abs=1e-4)


def test_paths_of_a_huffman_tree():
    weights = [1000, 500, *range(1, 60)]
    paths, nodes = language_model.huffman(weights)
    assert len({tuple(x) for x in paths}) == len(weights)
    assert len(paths[0]) == 1 and max(map(len, paths)) == 3 or len(paths[2]) >= 2
    for path, w in zip(paths, weights, strict=True):
        assert nodes[path[-1][0]][path[-1][1]] == w
    assert language_model.huffman([5]) == ([[]], [])


def test_language_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_model.score_documents(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert found.s > 1.0 * found.b


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, operator, label):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = operator.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = [(x.predicted == x[label]) for x in found.collect()]
    assert len(right) > 50 and np.mean(right) > 0.85


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_of_awkward_rows(spark, awkward, empty, operator):
    labels = spark.createDataFrame(
        [(5, 1, 0), (10, 0, 1), (15, 1, 0), (20, 0, 1), (20, None, None), (None, 1, 1), (25, 1, 0), (30, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = operator.classify(awkward, labels).collect()
    assert len(found) == awkward.count()
    assert all(0 <= x.score <= 1 for x in found)
    assert {(x.doc_id, x.held_out) for x in found} == {
        (d, zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0) for d, _ in pairs(awkward)
    }
    unlearned = operator.classify(awkward, labels.where("doc_id = 1")).collect()
    assert {x.score for x in unlearned} == {0.5}
    assert operator.classify(empty, labels).count() == 0


def test_accepted_keeps_columns(spark, awkward):
    labels = spark.createDataFrame([(5, 1), (10, 0)], "doc_id long, quality int")
    assert quality.accepted(awkward, labels).schema == awkward.schema


def test_sample_leaves_the_held_out_fold_out(spark, awkward):
    docs = [d for d, _ in pairs(awkward) if d is not None]
    labels = spark.createDataFrame([(d, 1) for d in docs], "doc_id long, quality int")
    taken = [x.doc_id for x in labelled.sample(awkward, labels, "quality", 10, 10_000).collect()]
    assert 0 < len(taken) <= 10
    assert all(zlib.crc32(str(d).encode()) % 5 for d in taken)


def test_misspellings_share_subwords():
    words = ["idiotic", "horrible", "stupidly"]
    texts, labels = [], []
    for k in range(300):
        bad = k % 2
        texts.append(f"some plain words number {k} " + (words[k % 3] if bad else "pleasant"))
        labels.append(bad)
    shape = Shape(window=8, buckets=1 << 14)
    model = train([t.encode() for t in texts], np.array(labels), shape, Training(epochs=8))
    odds = model.log_odds([b"some plain words horrrible", b"some plain words pleasant", b""])
    assert odds[0] > odds[1] and np.isfinite(odds).all()
