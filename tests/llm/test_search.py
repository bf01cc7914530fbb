"""Decontamination, ranked search and periodic runs, against brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from eventloom.llm import decontamination, lexical_search, periodic_runs, terms
from helpers import awkward, empty  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def rows_of(frame, *columns):
    return [tuple(x) for x in frame.select(*columns).collect()]


def ordered(rows):
    return sorted(rows, key=lambda x: [(y is None, y or 0) if not isinstance(y, str) else (False, y) for y in x])


def hit_brute(docs, items):
    windows = defaultdict(set)
    for key, text in items:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if key is None else str(key))
    out = []
    for doc, text in docs:
        w = split(text)
        hit, names = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i : i + k]))
                if found:
                    names |= found
                    hit[i : i + k] = [True] * k
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), sum(hit), len(names), digest, any(hit)))
    return out


def passages(seed):
    """Documents of few different words with passages of items, copies and repeats; items of any length, and odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "dé", "E1", "日本", f"w{rng.randint(0, 30)}"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 14, 40, 80])))) for k in range(30)]
    items += [(99, None), (None, "null key"), (98, ""), (97, "..."), items[3], (96, items[4][1]), (items[5][0], "x y z")]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rng.choice([0, 1, 5, 30, 100]))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(own))
            own[at:at] = w[rng.randint(0, len(w) // 2) : len(w) - rng.randint(0, len(w) // 3)]
        docs.append((k, rng.choice([" ", "  ", ", ", "\n"]).join(own)))
    docs += [(500 + k, docs[7][1]) for k in range(30)] + [(7, docs[7][1]), (None, docs[8][1]), (900, None), (901, "")]
    docs += [(902, " ".join(["null key"] * 300)), (903, " ".join(x or "" for _, x in items) * 3)]
    return docs, items


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, 1 << 21, 1 << 22), (2, 150, 1 << 22), (3, 1 << 21, 700)])
def test_decontamination(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(decontamination, "ITEM_BYTES", block)
    docs, items = passages(seed)
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(x) for x in decontamination.report(texts, benchmark).collect()]
    want = hit_brute(docs, items)
    assert ordered(found) == ordered(want)
    kept = decontamination.decontaminated(texts, benchmark)
    assert ordered(rows_of(kept, "doc_id")) == ordered([(x[0],) for x in want if not x[5]])
    # the same, shard by shard in this process
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    named = {("" if k is None else str(k), t) for k, t in items if t}
    tests = decontamination.Tests([(k, t.encode()) for k, t in sorted(named)], 10)
    hit, names = decontamination.Search([(t or "").encode() for _, t in docs], tests).hits()
    assert int(hit.sum()) == sum(x[2] for x in want)
    assert [len(x) for x in names] == [x[3] for x in want]


def test_longest_matches(spark):
    body = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(["x", *body[:25], "y"])), (2, " ".join(body[20:50])), (3, "w1 w2 w3"), (4, " ".join(body[5:16]))]
    texts = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("i", " ".join(body)), ("short", "w2 w3")], "item_id string, text string")
    found = {tuple(x) for x in decontamination.matches(texts, items).collect()}
    assert found == {
        ("i", 0, 1, 1, 25),  # the longest one from each suffix; document 4 has none that is not within this one
        ("i", 20, 2, 0, 30),
        ("short", 0, 1, 3, 2),
        ("short", 0, 3, 1, 2),
    }


def test_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    for words in (2, 3, 2000):
        for n in (0, 1, 7, 300):
            data = rng.integers(0, words, n).astype(np.int32)
            data[n // 2 :] = data[: n - n // 2]  # a long repeat
            shard = decontamination.Shard(data, 1 << 20)

            def suffix(i, data=data):
                rest = data[i:].tolist()
                return rest[: rest.index(0)] if 0 in rest else rest

            found = [suffix(i) for i in shard.sa.tolist()]
            assert found == sorted(found)
            assert sorted(shard.sa.tolist()) == np.flatnonzero(data).tolist()


def test_decontamination_of_odd_tables(spark, awkward, empty):
    items = spark.createDataFrame([(1, "it's a"), (2, None)], "item_id long, text string")
    docs = rows_of(awkward, "doc_id", "text")
    found = [tuple(x) for x in decontamination.report(awkward, items).collect()]
    assert ordered(found) == ordered(hit_brute(docs, [(1, "it's a")]))
    assert decontamination.report(empty, items).count() == 0
    nothing = items.where("item_id > 5")
    assert [x.n_hit for x in decontamination.report(awkward, nothing).collect()] == [0] * len(docs)
    kept = decontamination.decontaminated(awkward, nothing)
    assert kept.columns == awkward.columns
    assert kept.count() == len(docs)


def ranked_brute(docs, items, top=10):
    counts = [(doc, Counter(split(text))) for doc, text in docs]
    counts = [x for x in counts if x[1]]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    n = len(counts)
    weight = {term: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for term, k in df.items()}
    out = []
    for key, text in items:
        best = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                best.append((-score, doc is None, doc or 0))
        out += [(key, k + 1, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(best)[:top])]
    return out


@pytest.mark.parametrize(("seed", "terms_", "block"), [(4, 1 << 20, 1 << 20), (5, 300, 900)])
def test_lexical_search(spark, monkeypatch, seed, terms_, block):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", block)
    docs, items = passages(seed)
    items = [x for x in dict.fromkeys(items) if x != (items[5][0], "x y z")]
    texts = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(x) for x in lexical_search.search(texts, queries).collect()]
    assert ordered(found) == ordered(ranked_brute(docs, items))


def test_search_over_odd_tables(spark, awkward, empty):
    items = spark.createDataFrame([("k", "it's a w1é w2é"), ("l", None), ("m", "!")], "item_id string, text string")
    docs = rows_of(awkward, "doc_id", "text")
    found = [tuple(x) for x in lexical_search.search(awkward, items).collect()]
    assert ordered(found) == ordered(ranked_brute(docs, [("k", "it's a w1é w2é")]))
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(awkward, items.where("item_id > 'x'")).count() == 0


def test_bounds_are_never_below_the_score_and_leave_most_out():
    rng = np.random.default_rng(6)
    many, width = 400, 3000
    sizes = rng.integers(1, 60, many)
    rows = [np.sort(rng.choice(np.arange(1, width), n, replace=False)) for n in sizes]
    counts = np.minimum(rng.geometric(0.5, int(sizes.sum())), 40)
    known = lexical_search.Weights(many, int(counts.sum()), rng.integers(0, 9000, width))
    n = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
    row = {
        "doc_id": np.arange(many).astype("<i8").tobytes(),
        "missing": np.zeros(many, bool).tobytes(),
        "n": n.astype("<i8").tobytes(),
        "sizes": sizes.astype("<i4").tobytes(),
        "terms": np.concatenate(rows).astype("<i4").tobytes(),
        "counts": counts.astype("<i4").tobytes(),
    }
    block = lexical_search.Block([row], known)
    rescored = 0
    for _ in range(50):
        own = np.unique(rng.choice(np.arange(1, width), 25))
        weight = known.weight[own]
        for docs, slices in block.slices:
            assert (slices.bounds(own, weight) >= block.scores(docs, own, weight)).all()
        best = lexical_search.Best(5)
        rescored += block.search(own, weight, best)
        scores = block.scores(np.arange(many), own, weight)
        want = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s > 0)[:5]
        assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc_id.tolist(), strict=True)] == want
    assert rescored < 50 * many / 4


def test_terms_of_a_long_text_are_split_in_parts(monkeypatch):
    text = ("Añb1-c " * 50 + "x" * 100 + " y").encode()
    whole = [x for part in terms.split(text) for x in part]
    monkeypatch.setattr(terms, "PART", 13)
    assert [x for part in terms.split(text) for x in part] == whole == [x.encode() for x in split(text.decode())]


def runs_brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def report_brute(doc, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if doc is not None and w and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = runs_brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc,
        len(runs),
        *((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def periodic(seed, many):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [str(rng.randint(0, rng.choice([0, 1, 2, 9]))) for _ in range(rng.randint(1, rng.choice([1, 2, 5, 30])))]
            words += (unit * rng.randint(1, 9))[rng.randint(0, 2) :]
        out.append(words)
    return out


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_runs(monkeypatch, part):
    monkeypatch.setattr(periodic_runs, "PART", part)
    texts = periodic(7, 400)
    for i in range(0, len(texts), 8):
        some = [np.array(x, dtype=np.int64) for x in texts[i : i + 8]]
        for words, found in zip(some, periodic_runs.runs_of(some), strict=True):
            assert [tuple(x) for x in found.tolist()] == runs_brute(words.tolist())


def test_extensions():
    """Answers of the grammar against a walk over the words."""
    rng = random.Random(8)
    texts = [np.array(x, dtype=np.int64) for x in periodic(9, 40) if len(x) > 1]
    grammar = periodic_runs.Grammar(texts)
    for k, words in enumerate(texts):
        n = len(words)
        pairs = [sorted(rng.sample(range(n + 1), 2)) for _ in range(40)]
        one, two = (np.array(x) for x in zip(*pairs, strict=True))
        forth = grammar.extend(grammar.first[k] + one, grammar.first[k] + two, forwards=True)
        back = grammar.extend(grammar.first[k] + one, grammar.first[k] + two, forwards=False)
        for (a, b), f, g in zip(pairs, forth.tolist(), back.tolist(), strict=True):
            assert f == next((d for d in range(n - b) if words[a + d] != words[b + d]), n - b)
            assert g == next((d for d in range(a) if words[a - 1 - d] != words[b - 1 - d]), a)


def test_run_report(spark, awkward, empty):
    rows = [(k, " ".join(x)) for k, x in enumerate(periodic(10, 150))]
    rows += [(1000 + d if d is not None else None, t) for d, t in rows_of(awkward, "doc_id", "text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(x) for x in periodic_runs.run_report(frame, plant=True).collect()]
    assert ordered(found) == ordered([report_brute(*x) for x in rows])
    assert periodic_runs.run_report(empty).count() == 0
    plain = {x.doc_id: x.text for x in periodic_runs.collapsed(frame).where("doc_id < 1000").collect()}
    listed = defaultdict(list)
    for x in periodic_runs.all_runs(frame).where("doc_id < 1000").collect():
        listed[x.doc_id].append((x.start, x.length, x.period))
    for doc, text in rows[:150]:
        runs = runs_brute(text.split())
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert sorted(listed[doc]) == runs
        assert plain[doc] == " ".join(x for i, x in enumerate(text.split()) if i not in gone)


def test_a_long_repeated_text():
    found = periodic_runs.runs_of([np.zeros(60_000, np.int64), np.tile(np.arange(7), 9_000)])
    assert [x.tolist() for x in found] == [[[0, 60_000, 1]], [[0, 63_000, 7]]]
