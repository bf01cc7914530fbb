"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences and clauses: up to and with their end marks (. ! ? , ; :) and line ends, or up to a line end.
Those without a word are left as they are and don't part their neighbours; the others are the sentences of all that
follows. Every run of several consecutive sentences counts that holds `LEAST` sentences and `WORDS` words at least; a text
without such a run is one run as a whole. It is enough to hash, from each sentence, the shortest such run that begins there
and the shortest that ends there: they cover every sentence of any longer run, wherever that is repeated. Runs are hashed
to 124 bits, on the sentences without the white space around them, and joined over the whole corpus: the occurrence that
comes first, by doc_id and then by place, stays, and every sentence that any later occurrence covers goes. What stays of a
text is its other sentences as they were.

Where a span stands several times in one document, the document itself knows which are later; over documents only the
smallest and the largest id of each span are aggregated, which combines before the shuffle, so a passage that a third of
all documents hold brings each reducer one row per task. The way back is a join that adaptive execution splits.

Null and empty texts have no sentences and stay empty. Of a very long text no more is held than some 100 bytes for each
sentence. Rows of the same doc_id
count as one document: they don't remove from each other. A null doc_id is never later than another document. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.chunks import _AS_IS
from eventloom.llm.shared import blocks, stored, texts_of
from eventloom.llm.words import encoded, hashed, mix

LEAST = 2
WORDS = 12
BLOCK_BYTES = 2 << 20
SENTENCE = re.compile(rb"[^.!?,;:\n]*[.!?,;:]+\n*|[^.!?,;:\n]+\n*|\n+")
ODD = np.uint64(0x9FB21C651E98DF25)
SCHEMA = "doc_id long, n_sentences long, n_removed long, text string"


@dataclass
class Runs:
    """The runs of some texts, by text and place; sentences are those of all texts in a row."""

    parts: list[list[bytes]]  # of each text, also those without a word
    begin: np.ndarray  # where the parts of each text begin
    part: np.ndarray  # the part that each sentence is
    text: np.ndarray  # the text of each run
    first: np.ndarray  # its first sentence
    size: np.ndarray  # how many sentences
    hi: np.ndarray
    lo: np.ndarray


def runs(texts: list[bytes], least: int, words: int) -> Runs:
    parts = [SENTENCE.findall(x) for x in texts]
    plain = [x.strip() for own in parts for x in own]
    counts = np.fromiter((len(x.split()) for x in plain), np.int64, len(plain))
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    part = np.flatnonzero(counts)
    counts = counts[part]
    owner = np.repeat(np.arange(len(texts)), many)[part]
    plain = [plain[k] for k in part.tolist()]
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    data, ends = np.frombuffer(b"".join(plain), dtype=np.uint8), np.cumsum(lengths)
    one, two = (hashed(data, ends - lengths, ends, _AS_IS, seed) for seed in (0, 1))

    first, last = shortest(counts, owner, least, words)
    bare = np.setdiff1d(owner, owner[first])  # texts that are a run as a whole
    first = np.concatenate([first, np.searchsorted(owner, bare)])
    last = np.concatenate([last, np.searchsorted(owner, bare, side="right") - 1])
    order = np.argsort(first, kind="stable")
    first, size = first[order], (last - first + 1)[order]
    hi, lo = size.astype(np.uint64), size.astype(np.uint64)
    on, k = np.arange(len(first)), 0
    while len(on):
        hi[on] = mix(hi[on] * ODD + one[first[on] + k])
        lo[on] = mix(lo[on] * ODD + two[first[on] + k])
        k += 1
        on = on[size[on] > k]
    return Runs(parts, np.cumsum(many) - many, part, owner[first], first, size, hi, lo)


def shortest(counts: np.ndarray, owner: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest runs that begin or end at each sentence; each run once."""
    if not len(counts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    upto = np.cumsum(counts)
    before, here, n = upto - counts, np.arange(len(counts)), len(counts)
    last = np.maximum(np.searchsorted(upto, before + words), here + least - 1)
    good = (last < n) & (owner[np.minimum(last, n - 1)] == owner)
    first = np.minimum(np.searchsorted(before, upto - words, side="right") - 1, here - least + 1)
    also = (first >= 0) & (owner[np.maximum(first, 0)] == owner)
    both = np.unique(np.concatenate([here[good] * n + last[good], first[also] * n + here[also]]))
    return both // n, both % n


def spans(docs: DataFrame, least: int, words: int) -> DataFrame:
    """Rows (hi, lo, doc_id): the distinct runs of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            own = runs(encoded(block.column("text")), least, words)
            order = np.lexsort((own.lo, own.hi, own.text))
            text, hi, lo = own.text[order], own.hi[order], own.lo[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            out = {
                "hi": pa.array(hi[new].view(np.int64)),
                "lo": pa.array(lo[new].view(np.int64)),
                "doc_id": block.column("doc_id").combine_chunks().take(pa.array(text[new])),
            }
            yield from pa.table(out).to_batches(max_chunksize=20_000)

    return texts_of(docs).mapInArrow(run, "hi long, lo long, doc_id long")


def without_repeats(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """Per document: its sentences, how many went, and the text of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            own = runs(encoded(block.column("text")), least, words)
            later = [frozenset() if x is None else frozenset((y["hi"], y["lo"]) for y in x) for x in block.column("later").to_pylist()]
            edges = np.zeros(len(own.part) + 1, dtype=np.int64)
            seen: set = set()
            at = -1
            hi, lo = own.hi.view(np.int64).tolist(), own.lo.view(np.int64).tolist()
            for k, first, size, x, y in zip(own.text.tolist(), own.first.tolist(), own.size.tolist(), hi, lo, strict=True):
                if k != at:
                    seen, at = set(later[k]), k
                if (x, y) in seen:
                    edges[first] += 1
                    edges[first + size] -= 1
                seen.add((x, y))
            gone = np.zeros(sum(map(len, own.parts)), dtype=bool)
            gone[own.part[np.cumsum(edges[:-1]) > 0]] = True
            total, removed, kept = [], [], []
            worded = np.zeros(len(gone), dtype=np.int64)
            worded[own.part] = 1
            for parts, start in zip(own.parts, own.begin.tolist(), strict=True):
                flags = gone[start : start + len(parts)].tolist()
                total.append(int(worded[start : start + len(parts)].sum()))
                removed.append(sum(flags))
                kept.append(b"".join([x for x, out in zip(parts, flags, strict=True) if not out]).decode())
            out = {
                "doc_id": block.column("doc_id").combine_chunks(),
                "n_sentences": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "text": pa.array(kept, pa.string()),
            }
            yield from pa.table(out).to_batches(max_chunksize=2_000)

    found = spans(docs, least, words)
    repeated = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # written first, so that the join has plain sides and adaptive execution can split a hot span
    repeated = stored(repeated.where("low < high").select("hi", "lo", "low"), "spans")
    later = found.join(repeated, ["hi", "lo"]).where("doc_id > low").distinct()
    later = later.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("hi", "lo")).alias("later"))
    texts = texts_of(docs)
    return texts.join(later, texts.doc_id == later._id, "left").select("doc_id", "text", "later").mapInArrow(run, SCHEMA)
