"""Benchmark decontamination with suffix arrays over the training documents.

A window is 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words of a
document inside any occurrence of a window are hit, and a document with a hit is contaminated.

* `Tests`: the items as numbers of their distinct words. A block of items has a bounded size, so it is broadcast; a larger
  benchmark is searched block by block.
* `Shard`: the documents of a block, as the same numbers, with a suffix array. A word that no test has, or the end of a
  document, ends all suffixes. Suffixes are sorted by as many words as numbers fit into 64 bits, and then by prefix
  doubling within what is still equal, to the length of the longest item.
* Every test suffix is looked up in every shard by binary search, word after word, all suffixes at once. The interval at
  the length of its window gives all occurrences; the last interval that is not empty gives its longest verbatim matches
  with their locations (`matches`).

Documents are searched where they are read, so nothing is shuffled, and copies, frequent words or passages have no
group that could grow. Shards of long texts are cut with an overlap of the longest item, so memory beyond the text itself
and 4 bytes a word is bounded. Words are told apart by their bytes.

Null and empty texts have no words and are never hit. Rows are independent: repeated rows and ids, or a null doc_id, give
a result each. Items with a null text have no window; rows of one item_id are one item, and a null item_id is named as an
empty text. An empty table of documents gives an empty result, an empty benchmark one without hits; other columns are
ignored (`decontaminated` returns them as they were).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import blocks, texts_of
from eventloom.llm.terms import Vocabulary, query_blocks
from eventloom.llm.words import encoded

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words of a shard, besides the overlap.
SHARD_WORDS = 2 << 20
#: Bytes of a block of items.
ITEM_BYTES = 4 << 20


class Tests:
    """A block of items: their words as numbers, and where their windows stand."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary = Vocabulary(text for _, text in items)
        texts = self.vocabulary.texts
        del self.vocabulary.texts
        self.depth = max(map(len, texts), default=0)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        self.words = np.zeros(int((sizes + 1).sum()) + 1, np.int32)  # 0 after every item
        for at, own in zip(begin.tolist(), texts, strict=True):
            self.words[at : at + len(own)] = own
        need = np.minimum(sizes, window)
        many = np.where(sizes > 0, sizes - need + 1, 0)
        self.item = np.repeat(np.arange(len(texts)), many)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many)
        self.first = begin[self.item] + self.place
        self.need = need[self.item]

    def content(self, window: int) -> bytes:
        at = self.first[window]
        return self.words[at : at + self.need[window]].tobytes()

    @cached_property
    def named(self) -> dict[bytes, set[str]]:
        """The names of all items that have a window, by its content."""
        out: dict[bytes, set[str]] = {}
        for window, item in enumerate(self.item.tolist()):
            out.setdefault(self.content(window), set()).add(self.names[item])
        return out


class Shard:
    """A suffix array over word numbers, of which 0 ends every suffix; suffixes are sorted by `depth` words."""

    def __init__(self, words: np.ndarray, depth: int):
        n = len(words)
        self.words = np.append(words, np.int32(0))
        zero = np.flatnonzero(self.words == 0)
        first = np.flatnonzero(words)
        left = zero[np.searchsorted(zero, first)] - first  # words until the end of each suffix
        remaining = np.zeros(n + 1, np.int64)
        remaining[first] = left
        bits = max(1, int(words.max(initial=0)).bit_length())
        h = max(1, 62 // bits)
        key = np.zeros(len(first), np.int64)
        for k in range(h):
            key = key << bits | np.where(left > k, self.words[np.minimum(first + k, n)], 0)
        order = np.argsort(key, kind="stable")
        sa, key = first[order], key[order]
        rank = np.zeros(n + 1, np.int64)  # the place of a suffix's group, from 1
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        rank[sa] = np.repeat(heads + 1, np.diff(np.append(heads, len(sa))))
        while h < depth:
            group = rank[sa]
            tied = np.zeros(len(sa), dtype=bool)
            tied[1:] = group[1:] == group[:-1]
            tied[:-1] |= tied[1:].copy()
            at = np.flatnonzero(tied)
            longer = remaining[sa[at]] > h
            if not longer.any():
                break
            second = np.where(longer, rank[np.minimum(sa[at] + h, n)], 0)
            order = np.lexsort((second, group[at]))
            sa[at], second, group = sa[at][order], second[order], group[at]
            new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0))
            rank[sa[at]] = np.repeat(at[new] + 1, np.diff(np.append(new, len(at))))
            h *= 2
        self.sa, self.initial = sa, self.words[sa]

    def bound(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where, between two places that share `depth` words, suffixes begin whose next word is not below `word`."""
        low, high = low.copy(), high.copy()
        on = np.flatnonzero(low < high)
        while len(on):
            middle = (low[on] + high[on]) >> 1
            below = self.words[self.sa[middle] + depth[on]] < word[on]
            low[on[below]] = middle[below] + 1
            high[on[~below]] = middle[~below]
            on = on[low[on] < high[on]]
        return low

    def lookup(self, tests: Tests, longest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur: their number, the words that match, and the interval of suffixes that begin with these.

        As many words match as the window has, or with `longest` as many as the shard has anywhere.
        """
        word = tests.words[tests.first]
        low, high = np.searchsorted(self.initial, word), np.searchsorted(self.initial, word, side="right")
        who = np.flatnonzero(low < high)
        low, high, depth = low[who], high[who], np.ones(len(who), np.int64)
        done = []
        while len(who):
            word = tests.words[tests.first[who] + depth]
            on = word > 0
            if not longest:
                on &= depth < tests.need[who]
            a = self.bound(low, np.where(on, high, low), depth, word)
            b = self.bound(a, np.where(on, high, a), depth, word + 1)
            on &= a < b
            end = ~on & (depth >= tests.need[who])
            done.append((who[end], depth[end], low[end], high[end]))
            who, low, high, depth = who[on], a[on], b[on], depth[on] + 1
        empty = (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(empty, *done, strict=True))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places of some intervals, one after the other."""
    each = high - low
    return np.repeat(low - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))


class Search:
    """The documents of a block: where their words are, and shards of them."""

    def __init__(self, texts: list[bytes], tests: Tests):
        self.tests = tests
        numbers = [tests.vocabulary.numbers(x) for x in texts]
        self.sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.concatenate([np.zeros(0, np.int32), *[np.append(x, np.int32(0)) for x in numbers]])

    def found(self, longest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard, of all occurrences: the window's number, the words that match, and the place."""
        for cut in range(0, len(self.words), SHARD_WORDS):
            shard = Shard(self.words[cut : cut + SHARD_WORDS + self.tests.depth], self.tests.depth)
            which, depth, low, high = shard.lookup(self.tests, longest)
            if not longest:  # equal windows have equal intervals; their first stands for all
                _, one = np.unique(np.stack([low, depth]), axis=1, return_index=True)
                which, depth, low, high = which[one], depth[one], low[one], high[one]
            upto = np.cumsum(high - low)
            i = 0
            while i < len(which):  # about a million occurrences at once
                end = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (1 << 20), side="right")))
                part = slice(i, end)
                each = high[part] - low[part]
                at = shard.sa[ranges(low[part], high[part])]
                own = at < SHARD_WORDS  # later ones begin in the next shard
                yield np.repeat(which[part], each)[own], np.repeat(depth[part], each)[own], cut + at[own]
                i = end

    def hits(self) -> tuple[np.ndarray, list[list[str]]]:
        """Whether each place is hit, and the names of the items that each text holds a window of."""
        edges = np.zeros(len(self.words) + 1, np.int64)
        many = max(1, len(self.tests.item))
        pairs = [np.empty(0, np.int64)]
        for which, depth, at in self.found(longest=False):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + depth, -1)
            pairs.append(np.unique((np.searchsorted(self.begin, at, side="right") - 1) * many + which))
        text, which = np.divmod(np.unique(np.concatenate(pairs)), many)
        known: dict[bytes, list[str]] = {b"": []}
        cuts = np.searchsorted(text, np.arange(len(self.sizes) + 1))
        items = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = which[a:b]
            code = own.tobytes()
            if code not in known:
                named = [self.tests.named[self.tests.content(w)] for w in own.tolist()]
                known[code] = sorted(set().union(*named))
            items.append(known[code])
        return np.cumsum(edges[:-1]) > 0, items


def test_blocks(docs: DataFrame, benchmark: DataFrame, window: int) -> Iterator:
    """The benchmark, block by block, as broadcast `Tests`."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for rows in query_blocks(items, "item_id", ITEM_BYTES):
        tests = Tests([(x.item_id, x.text.encode()) for x in rows], window)
        yield docs.sparkSession.sparkContext.broadcast(tests)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, how many are hit, and the items whose windows it holds."""

    def step(shared, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, BLOCK_BYTES):
                search = Search(encoded(block.column("text")), shared.value)
                hit, items = search.hits()
                flags = [hit[a : a + n] for a, n in zip(search.begin.tolist(), search.sizes.tolist(), strict=True)]
                if "hits" in block.column_names:
                    for own, earlier in zip(flags, block.column("hits").to_pylist(), strict=True):
                        own |= np.unpackbits(np.frombuffer(earlier, np.uint8), count=len(own)).astype(bool)
                    items = [sorted({*a, *b}) for a, b in zip(items, block.column("items").to_pylist(), strict=True)]
                out = {"doc_id": block.column("doc_id").combine_chunks()}
                if last:
                    out["n_words"] = pa.array(search.sizes)
                    out["n_hit"] = pa.array([int(x.sum()) for x in flags], pa.int64())
                else:
                    out["text"] = block.column("text").combine_chunks()
                    out["hits"] = pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())
                out["items"] = pa.array(items, pa.list_(pa.string()))
                yield from pa.table(out).to_batches(max_chunksize=2_000)

        return run

    found = texts_of(docs)
    shared = list(test_blocks(docs, benchmark, window))
    for own in shared[:-1]:
        found = found.mapInArrow(step(own, last=False), "doc_id long, text string, hits binary, items array<string>")
    return found.mapInArrow(step(shared[-1], last=True), "doc_id long, n_words long, n_hit long, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`contamination` with the names of the items as a number and a digest."""
    names = F.array_join("items", ",").cast("binary")
    return contamination(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window, with all their columns."""
    for shared in test_blocks(docs, benchmark, window):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, BLOCK_BYTES):
                search = Search(encoded(block.column("text")), shared.value)
                hit, _ = search.hits()
                clean = [not hit[a : a + n].any() for a, n in zip(search.begin.tolist(), search.sizes.tolist(), strict=True)]
                yield from block.filter(pa.array(clean, pa.bool_())).to_batches(max_chunksize=2_000)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches of every test suffix in each shard, of a window at least, and where they stand.

    Columns item_id, item_word, doc_id, doc_word (from 0) and words. A suffix whose match only continues that of the
    suffix before it, at the same place, is left out.
    """
    schema = "item_id string, item_word long, doc_id long, doc_word long, words long"

    def step(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, BLOCK_BYTES):
                tests = shared.value
                search = Search(encoded(block.column("text")), tests)
                ids = block.column("doc_id").combine_chunks()
                for which, depth, at in search.found(longest=True):
                    before = tests.words[tests.first[which] - 1]
                    fresh = (tests.place[which] == 0) | (at == 0) | (before != search.words[at - 1])
                    which, depth, at = which[fresh], depth[fresh], at[fresh]
                    text = np.searchsorted(search.begin, at, side="right") - 1
                    out = {
                        "item_id": pa.array([tests.names[k] for k in tests.item[which].tolist()], pa.string()),
                        "item_word": pa.array(tests.place[which]),
                        "doc_id": ids.take(pa.array(text)),
                        "doc_word": pa.array(at - search.begin[text]),
                        "words": pa.array(depth),
                    }
                    yield from pa.table(out).to_batches(max_chunksize=20_000)

        return run

    texts = texts_of(docs)
    found = [texts.mapInArrow(step(shared), schema) for shared in test_blocks(docs, benchmark, window)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
