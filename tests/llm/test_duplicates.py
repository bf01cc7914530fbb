"""Exact and near duplicates, repeated strings and repeated sentences, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from eventloom.llm import exact_dedup, jaccard, sentence_spans, suffix_dedup
from eventloom.llm.graph import components
from helpers import awkward, empty, pairs  # noqa: F401


def ranked(doc):
    return -(1 << 63) if doc is None else doc


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text].append(doc)
    out = Counter()
    for doc, text in rows:
        keep = max(groups[text], key=ranked)
        out[doc, keep, len(groups[text]), doc == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table_bytes", [64 << 20, 200])
def test_exact_groups(awkward, empty, table_bytes):
    found = exact_dedup.exact_groups(awkward, table_bytes).collect()
    assert Counter(map(tuple, found)) == exact_brute(pairs(awkward))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_copies_go_with_their_columns(awkward):
    kept = exact_dedup.without_copies(awkward)
    assert kept.columns == awkward.columns
    texts = [x.text or "" for x in kept.dropDuplicates(["doc_id", "text"]).collect()]
    assert sorted(texts) == sorted({t for _, t in pairs(awkward)})


def test_equal_hashes_are_told_apart_by_content():
    table = exact_dedup.OpenTable(1)
    assert [table.number(7, x) for x in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    assert [table.number(k % 3, str(k).encode()) for k in range(200)] == list(range(3, 203))


def test_grace_recurses_until_a_bucket_fits():
    rng = np.random.default_rng(1)
    texts = [f"{k % 70}" * 30 for k in range(400)]
    hashes = {t: int(x) for t, x in zip(sorted(set(texts)), rng.integers(-(1 << 62), 1 << 62, 70), strict=True)}
    batch = pa.table(
        {
            "row": list(range(400)),
            "hash": pa.array([hashes[t] for t in texts], pa.int64()),
            "text": texts,
            "largest": pa.array([None if k == 0 else k for k in range(400)], pa.int64()),
            "n": [1] * 400,
        }
    )
    answers = {}
    for table in exact_dedup.grace(iter(batch.to_batches(max_chunksize=33)), limit=300):
        answers |= {r: (k, n) for r, k, n in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True)}
    for k, text in enumerate(texts):
        own = [i for i, t in enumerate(texts) if t == text]
        assert answers[k] == (max(own), len(own))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(5, 5), (2000, 2001), (2001, 2000)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found.items() <= {x: root(x) for x in parent}.items() | set()
    assert all(found.get(x, x) == root(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(first.get(root(i), doc), doc)
    return Counter((doc, len(sets[i]), first.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        n = rng.choice([3, 5, 8, 11, 14, 20, 30, 60, 100, 200])
        base = [f"W{rng.randint(0, 400)}" for _ in range(n)]
        for _ in range(rng.choice([2, 4, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at, what = rng.randrange(len(own)), rng.random()
                if what < 0.4:
                    own[at] = f"z{rng.randint(0, 99)}"
                elif what < 0.7 and len(own) > 1:
                    del own[at]
                else:
                    own.insert(at, "q")
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "chunk"), [(3, 90, 512), (5, 80, 3)])
def test_near_duplicates(spark, awkward, monkeypatch, width, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_rows(width) + [(100_000 + (d or 0) if d is not None else None, t) for d, t in pairs(awkward)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.near_duplicates(frame, width, percent).collect())) == near_brute(rows, width, percent)


def test_pairs_of_a_large_group_grow_with_its_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    words = [f"w{k}" for k in range(160)]
    rows = [(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(150)]  # all of them link
    compared, whole = [], jaccard.stored

    def counted(frame, label):
        frame = whole(frame, label)
        if label == "pairs":
            compared.append(frame.count())
        return frame

    monkeypatch.setattr(jaccard, "stored", counted)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {x.component_id for x in found} == {0} and len(found) == len(rows)
    assert sum(compared) <= 3 * len(rows)


def test_near_duplicates_of_nothing(empty):
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.one_of_each(empty).columns == empty.columns


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_sets_that_link_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    tried = 0
    for _ in range(600):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 150)), dtype=np.uint64)
        a, b = (np.unique(base[rng.random(len(base)) < rng.uniform(0.85, 1)]) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < percent * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        tried += 1
        assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))
    assert tried > 20


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 5000, 400, dtype=np.uint64))
        b = np.unique(rng.integers(0, 5000, int(rng.integers(100, 900)), dtype=np.uint64))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def strings_brute(rows, length):
    first = {}
    for doc, text in rows:
        b = text.encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], ranked(doc)), ranked(doc))
    out = Counter()
    for doc, text in rows:
        b = text.encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < ranked(doc):
                gone[p : p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def string_rows():
    rng = random.Random(5)
    letters = "abcdeé \n"
    passages = ["".join(rng.choices(letters, k=rng.choice([49, 50, 51, 60, 120, 300]))) for _ in range(12)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 5)):
            text += "".join(rng.choices(letters, k=rng.choice([0, 3, 30, 200])))
            if rng.random() < 0.7:
                passage = rng.choice(passages)
                text += passage[rng.randint(0, len(passage) // 3) if rng.random() < 0.4 else 0 :]
        rows.append((i, "x" * rng.randint(40, 300) if rng.random() < 0.1 else text))
    rows += [(200, ""), (201, rows[0][1]), (202, rows[0][1]), (202, rows[0][1]), (203, passages[4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "block"), [(8192, 8 << 20), (2, 5000)])
def test_repeated_strings(spark, awkward, empty, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", block // 2)
    rows = string_rows() + [(1000 + d if d is not None else None, t) for d, t in pairs(awkward)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.deduplicated(frame, hot=hot).collect()
    assert Counter(map(tuple, found)) == strings_brute(rows, suffix_dedup.LENGTH)
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_texts_without_repeated_strings_keep_their_columns(awkward, empty):
    found = suffix_dedup.without_repeats(awkward)
    assert found.schema == awkward.schema
    digests = Counter((x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in found.collect())
    assert digests == Counter({(k[0], k[4]): n for k, n in strings_brute(pairs(awkward), suffix_dedup.LENGTH).items()})
    assert all(x.n_chars == len(x.text) for x in found.collect())
    assert suffix_dedup.without_repeats(empty).schema == empty.schema


def test_rows_without_an_id_are_spread_over_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2_000)
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=120))
    rows = [(None if k % 3 == 0 else k // 2, "".join(rng.choices("ijklmn ", k=90)) + passage * (k % 4 == 1)) for k in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed, sizes = suffix_dedup.in_blocks(frame)
    assert sizes["blocks"] > 3
    assert placed.where("doc_id IS NULL").select("block").distinct().count() > 3
    found = Counter(map(tuple, suffix_dedup.deduplicated(frame).collect()))
    assert found == strings_brute([(d, t) for d, t in rows], suffix_dedup.LENGTH)


def test_multikey_order():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 3, (500, 21), dtype=np.uint8)
    rows[::3, :17] = 1
    order, alike = suffix_dedup.multikey_order(rows)
    lines = [rows[i].tobytes() for i in order]
    assert lines == sorted(lines)
    for a, b, n in zip(lines, lines[1:], alike.tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 21 or a[n] != b[n])


def test_grams_of_many_blocks_are_told_in_one_pass(monkeypatch):
    rng = np.random.default_rng(7)
    own = [np.unique(rng.integers(0, 100_000, 200, dtype=np.uint32)) for _ in range(2_000)]
    sizes = [rng.integers(0, 3, len(x)).astype(np.uint8) for x in own]
    columns = [[0] * len(own), range(len(own)), [x.tobytes() for x in own], [x.tobytes() for x in sizes]]
    rows = pa.table([pa.array(x, y) for x, y in zip(columns, suffix_dedup.arrow(suffix_dedup.GRAMS).types, strict=True)], ["bucket", "block", "grams", "sizes"])
    blocks, total = Counter(), Counter()
    for grams, logs in zip(own, sizes, strict=True):
        blocks.update(grams.tolist())
        total.update(dict(zip(grams.tolist(), (1 << logs.astype(int)).tolist(), strict=True)))
    searches = []
    monkeypatch.setattr(np, "isin", lambda *x, isin=np.isin, **y: searches.append(x) or isin(*x, **y))
    told = suffix_dedup.shared_grams(rows, 8).to_pylist()
    assert len(searches) <= 2  # not all shared grams for each block anew
    assert [x["block"] for x in told] == list(range(len(own)))
    for grams, x in zip(own, told, strict=True):
        assert np.frombuffer(x["grams"], np.uint32).tolist() == [g for g in grams.tolist() if blocks[g] > 1]
        assert np.frombuffer(x["hot"], np.uint32).tolist() == [g for g in grams.tolist() if total[g] > 8]


def test_strings_of_hot_grams_go_to_each_bucket_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 13)  # a part has an eighth of it
    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + "the " * 60 for _ in range(40)]
    block = pa.table({"doc_id": range(40), "text": texts, "block": pa.array([3] * 40, pa.int32())})
    own = suffix_dedup.Block.of(block)
    which, code = suffix_dedup.dealt(np.unique(suffix_dedup.anchors(own.data, own.room)[1]), 7)
    grams = [code[which == b].tobytes() for b in range(7)]
    answers = pa.table({"bucket": range(7), "block": [3] * 7, "grams": grams, "hot": grams})
    lines = [x for x in suffix_dedup.sent_anchors(block, answers, np.empty(0, "S16"), 7) if not x["known"]]
    assert len(lines) <= 7 + len(own.data) // 1024
    sent = set()
    for x in lines:
        around, left, _, doc, _ = suffix_dedup.unpacked(x["packed"], x["n"], suffix_dedup.WIDTH, 1, 1, 8, 8)
        strings = [y[suffix_dedup.LEFT :].tobytes() for y in around.reshape(-1, suffix_dedup.WIDTH)]
        docs = suffix_dedup.numbers_of([doc.reshape(8, -1)]).tolist()
        assert not left.any()
        sent |= set(zip(strings, docs, strict=True))
    first = {}
    for doc, text in enumerate(texts):
        for p in range(len(text) - suffix_dedup.LENGTH + 1):
            first.setdefault(text[p : p + suffix_dedup.LENGTH].encode(), doc)
    assert set(first.items()) <= sent


def test_grams_that_share_their_bits_lose_nothing(spark, monkeypatch):
    rows = string_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with monkeypatch.context() as few:  # two bits for each gram
        few.setattr(suffix_dedup, "BLOCK_BYTES", 5_000)
        few.setattr(suffix_dedup, "BUCKET_BYTES", 2_500)
        plain, sizes = suffix_dedup.in_blocks(frame)
        blocks = [pa.Table.from_pylist([x.asDict() for x in own], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())])) for own in grouped(plain.collect())]
        few.setattr(suffix_dedup, "dealt", lambda grams, buckets, own=suffix_dedup.dealt: (own(grams, buckets)[0], own(grams, buckets)[1] & np.uint32(3)))
        assert sizes["blocks"] > 3
        found = list(suffix_found(blocks, sizes["buckets"], 3))
    assert Counter(found) == strings_brute(rows, suffix_dedup.LENGTH)


def grouped(rows):
    out = defaultdict(list)
    for x in rows:
        out[x.block].append(x)
    return list(out.values())


def suffix_found(blocks, buckets, hot):
    """All steps on some blocks, without Spark."""

    def by(tables, key):
        table = pa.concat_tables(tables)
        return {k: table.filter(np.array(table.column(key).to_pylist()) == k) for k in set(table.column(key).to_pylist())}

    def table(lines, ddl):
        return suffix_dedup.as_table(lines, suffix_dedup.arrow(ddl))

    grams = by([suffix_dedup.own_grams(x, buckets) for x in blocks], "bucket")
    told = by([suffix_dedup.shared_grams(x, hot) for x in grams.values()], "block")
    none = suffix_dedup.arrow(suffix_dedup.TOLD).empty_table()
    splitters = np.array([b"a", b"c", b"e"], "S16")
    sent = [table(suffix_dedup.sent_anchors(x, told.get(x.column("block")[0].as_py(), none), splitters, buckets), suffix_dedup.ANCHORS) for x in blocks]
    found = by([table(suffix_dedup.sorted_bucket(x), suffix_dedup.FOUND) for x in by(sent, "bucket").values()], "block")
    none = suffix_dedup.arrow(suffix_dedup.FOUND).empty_table()
    for x in blocks:
        for line in suffix_dedup.digests(x, found.get(x.column("block")[0].as_py(), none)).to_pylist():
            yield tuple(line.values())


def test_grams_are_dealt_and_told_by_bucket_and_bits():
    grams = np.array([7, 7 + (5 << 32), 12], dtype=np.uint64)  # the first two are one in their bucket
    which, code = suffix_dedup.dealt(grams, 5)
    mark = suffix_dedup.placed_at(which, code)
    assert mark[0] == mark[1] != mark[2]
    answers = pa.table({"bucket": [2, 3], "grams": [code[:1].tobytes(), b""]})
    assert suffix_dedup.told_of(mark, answers, "grams").tolist() == [True, True, False]
    assert suffix_dedup.told_of(mark, answers.slice(0, 0), "grams").tolist() == [False] * 3


def test_columns_of_runs_and_packed_lines():
    data, lengths = np.arange(9, dtype=np.uint64), np.array([0, 4, 0, 5, 0])
    column = pa.chunked_array([suffix_dedup.runs(data, lengths), pa.array([], pa.binary()), suffix_dedup.runs(data, lengths)[1:4]])
    found, each = suffix_dedup.flat(column, "<u8")
    assert found.tolist() == [*range(9), *range(9)] and each.tolist() == [0, 4, 0, 5, 0, 4, 0, 5]
    assert [x.tolist() for x in suffix_dedup.flat(pa.chunked_array([], pa.binary()), "u1")] == [[], []]
    numbers = np.array([-(1 << 63), -1, 0, 5, (1 << 40) + 3])
    wide = np.arange(10, dtype=np.uint8).reshape(5, 2)
    one, two = suffix_dedup.unpacked(suffix_dedup.packed(wide, suffix_dedup.bytes_of(numbers)), 5, 2, 8)
    assert one.reshape(-1, 2).tolist() == wide.tolist()
    assert suffix_dedup.numbers_of([two.reshape(8, -1)]).tolist() == numbers.tolist()


def every_run(own, least, words):
    """All runs of sentences, not only the shortest ones: first, behind the last, and content."""
    found = []
    for i in range(len(own)):
        for j in range(i + least, len(own) + 1):
            if sum(len(x.split()) for x in own[i:j]) >= words:
                found.append((i, j, tuple(own[i:j])))
    return found or ([(0, len(own), tuple(own))] if own else [])


def sentences_brute(rows, least, words):
    split = {text: sentence_spans.SENTENCE.findall(text.encode()) for _, text in rows}
    worded = {text: [x.strip() for x in own if x.split()] for text, own in split.items()}
    holders = defaultdict(set)
    for doc, text in rows:
        for _, _, key in every_run(worded[text], least, words):
            holders[key].add(doc)
    out = Counter()
    for doc, text in rows:
        gone, seen = set(), set()
        for i, j, key in every_run(worded[text], least, words):
            others = [d for d in holders[key] if d is not None]
            if key in seen or (doc is not None and doc > min(others)):
                gone |= set(range(i, j))
            seen.add(key)
        kept, k = [], 0
        for part in split[text]:
            if not part.split():
                kept.append(part)
            else:
                if k not in gone:
                    kept.append(part)
                k += 1
        out[doc, len(worded[text]), len(gone), b"".join(kept).decode()] += 1
    return out


def test_repeated_sentences(spark, awkward, empty):
    rng = random.Random(8)
    pool = [" ".join(rng.choices("alpha beta gamma delta. eps".split(), k=rng.randint(1, 7))) for _ in range(40)]
    rows = []
    for i in range(80):
        own = [rng.choice(pool) + rng.choice([". ", "! ", "?\n", "\n\n", ".. "]) for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.5:
            at = rng.randint(0, 30)
            own += [x + ". " for x in pool[at : at + 6]]
        rows.append((i, "".join(own)))
    passage = " ".join(f"p{k}" for k in range(30)) + ", " + " ".join(f"q{k}" for k in range(25))
    rows += [(600 + k, f"start {k} {passage} and end {k}.") for k in range(3)]  # of two sentences, both joined to others
    rows += [(700, "short."), (701, "short. "), (702, " \n \n short.\n\n \n"), (703, ",,, ... ::")]
    rows += [(500, rows[3][1] * 2), (501, rows[3][1])] + [(1000 + d if d is not None else None, t) for d, t in pairs(awkward)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sentence_spans.without_repeats(frame).collect()
    assert Counter(map(tuple, found)) == sentences_brute(rows, sentence_spans.LEAST, sentence_spans.WORDS)
    assert sentence_spans.without_repeats(empty).count() == 0
