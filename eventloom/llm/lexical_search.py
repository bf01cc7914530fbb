"""Ranked lexical search with bit-sliced Bloom signatures.

Every item of a query set ranks all documents by the weights of its terms and their frequencies in the document. A term's
weight is w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); with m = 10 + (90 * n * N) div L, tf occurrences of it add
w * ((10**9 * tf) div (1000 * tf + 8 * m)) to a document's score. N, L and df count all documents.

1. `indexed`: documents become blocks of their number of terms and the frequencies of query terms, written to the shared
   folder; only these are read from here on. Document frequencies are counted in each task before the shuffle.
2. `Slices`: in a block, documents of a similar number of terms share a bit matrix with a column per document. A term sets
   two rows by hash, so the rows' conjunction overestimates where the term stands. There is a matrix for each level of
   frequency (1, 2, 4, ... occurrences), so the sum of the levels' slices, each weighted with the most that its level can
   add to a score, is an upper bound for every document of the block at once.
3. Documents whose bound doesn't fall below the worst of the best found so far are rescored exactly, the highest bounds
   first. What is left out is provably not among the best. A task carries its best over all of its blocks and sends them
   once, so that an item brings its last step as many rows as there are tasks, times `top`.

A query set is broadcast in blocks of a bounded size. Terms are told apart by their bytes; hashes only make bounds.

Null and empty texts have no terms and don't count for N. Rows are documents, so repeated rows and ids are ranked each; a
null doc_id comes after others of its score. Of equal rows of the query set one counts, items without terms have no rows.
Empty tables give an empty result; other columns are ignored. Of a long text, only its terms' numbers are held besides it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import blocks, stored, texts_of
from eventloom.llm.terms import Vocabulary, query_blocks
from eventloom.llm.words import encoded, mix

TOP = 10
#: Bytes of text for a row of the index, and terms for a block that is searched.
ROW_BYTES = 2 << 20
BLOCK_TERMS = 1 << 20
#: Bytes of a block of the query set.
ITEM_BYTES = 1 << 20
#: Rows of a bit matrix for each term of its largest document, at least.
ROWS_PER_TERM = 8
#: Levels of frequency: 1, 2, 4, ...; the last has no upper end.
LEVELS = 5
INDEX = (
    "documents long, total long, doc_id binary, missing binary, n binary, sizes binary, terms binary, counts binary"
)


@dataclass
class Weights:
    """What is known of the whole corpus."""

    documents: int
    total: int
    weight: np.ndarray  # by number of the term


def indexed(docs: DataFrame, shared) -> DataFrame:
    """Blocks of documents; `terms` and `counts` run over all documents of a block, `sizes` of them for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for block in blocks(batches, ROW_BYTES):
            ids = block.column("doc_id").to_pylist()
            n, sizes, terms, counts = [], [], [], []
            for text in encoded(block.column("text")):
                numbers = vocabulary.numbers(text)
                own, times = np.unique(numbers[numbers > 0], return_counts=True)
                n.append(len(numbers))
                sizes.append(len(own))
                terms.append(own.astype("<i4"))
                counts.append(times.astype("<i4"))
            n = np.array(n, "<i8")
            row = {
                "documents": pa.array([int((n > 0).sum())], pa.int64()),
                "total": pa.array([int(n.sum())], pa.int64()),
                "doc_id": [np.array([k or 0 for k in ids], "<i8").tobytes()],
                "missing": [np.array([k is None for k in ids], bool).tobytes()],
                "n": [n.tobytes()],
                "sizes": [np.array(sizes, "<i4").tobytes()],
                "terms": [b"".join(x.tobytes() for x in terms)],
                "counts": [b"".join(x.tobytes() for x in counts)],
            }
            yield pa.RecordBatch.from_pydict(row)

    return texts_of(docs).mapInArrow(run, INDEX)


def weights(index: DataFrame, many: int) -> Weights:
    """Counts over all documents; one row for each of the query set's `many` terms comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(many + 1, np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                seen += np.bincount(np.frombuffer(terms, "<i4"), minlength=many + 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "df"])

    documents, total = index.agg(F.sum("documents"), F.sum("total")).first()
    out = Weights(documents or 0, total or 0, np.zeros(many + 1, np.int64))
    counted = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for row in counted.collect():
        out.weight[row.term] = math.floor(1000 * math.log((2 * out.documents + 2) / (2 * row.df + 1)))
    return out


def part(times, m):
    """What `times` occurrences add to a score, for a term of weight 1."""
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Slices:
    """Signatures of some documents: for each level of frequency a bit matrix, and the most that the level can add."""

    def __init__(self, doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray):
        """`doc` numbers the document of each entry from 0; `m` belongs to the documents."""
        self.many = len(m)
        most = np.zeros(self.many, np.int64)
        np.maximum.at(most, doc, counts)
        self.levels = []
        below = np.zeros(self.many, np.int64)
        for level in range(LEVELS):
            on = counts >= 1 << level
            if not on.any():
                break
            rows = ROWS_PER_TERM * int(np.bincount(doc[on]).max())
            rows = max(64, 1 << (rows - 1).bit_length())
            bits = np.zeros((rows, self.many), dtype=bool)
            for h in self.rows(terms[on], level, rows):
                bits[h, doc[on]] = True
            top = most if level == LEVELS - 1 else np.minimum(most, (2 << level) - 1)
            most_here = np.where(most >= 1 << level, part(top, m), below)
            self.levels.append((np.packbits(bits, axis=1), rows, (most_here - below).astype(np.float64)))
            below = most_here

    @staticmethod
    def rows(terms: np.ndarray, level: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(terms.astype(np.uint64) + np.uint64(level << 40))
        return (h % np.uint64(rows)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(rows)).astype(np.int64)

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """An upper bound of every document's score. Sums stay below 2**53, so they are exact."""
        out = np.zeros(self.many)
        for level, (packed, rows, most) in enumerate(self.levels):
            a, b = self.rows(terms, level, rows)
            present = np.unpackbits(packed[a] & packed[b], axis=1, count=self.many)
            out += (weight @ present) * most
        return out


class Best:
    """The best documents of an item so far."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.missing, self.doc_id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A smaller score is not among the best."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        keep = score >= self.least
        score, missing, doc_id = (
            np.concatenate([x, y[keep]])
            for x, y in ((self.score, score), (self.missing, missing), (self.doc_id, doc_id))
        )
        order = np.lexsort((doc_id, missing, -score))[: self.top]
        self.score, self.missing, self.doc_id = score[order], missing[order], doc_id[order]


class Block:
    """Some rows of the index, with their signatures."""

    def __init__(self, rows: list[dict], known: Weights):
        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join([x[name] for x in rows]), kind)

        self.doc_id, self.n, self.missing = column("doc_id", "<i8"), column("n", "<i8"), column("missing", bool)
        sizes, self.terms, self.counts = (column(x, "<i4").astype(np.int64) for x in ("sizes", "terms", "counts"))
        self.m = 10 + 90 * self.n * known.documents // max(1, known.total)
        self.width = len(known.weight)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.keys = doc * self.width + self.terms  # ascends
        kind = np.frexp(sizes)[1]  # documents of 2**(k-1) to 2**k - 1 terms
        self.slices = []
        for k in np.unique(kind[sizes > 0]).tolist():
            own = np.flatnonzero(kind == k)
            place = np.full(len(sizes), -1)
            place[own] = np.arange(len(own))
            on = place[doc] >= 0
            self.slices.append((own, Slices(place[doc[on]], self.terms[on], self.counts[on], self.m[own])))

    def scores(self, docs: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        wanted = docs[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        times = np.where(self.keys[at] == wanted, self.counts[at], 0)
        return (weight * part(times, self.m[docs, None])).sum(axis=1)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Bring an item's best up to date; returns how many documents were rescored."""
        docs, bounds = [np.empty(0, np.int64)], [np.empty(0)]
        for own, slices in self.slices:
            upper = slices.bounds(terms, weight)
            on = upper >= best.least
            docs.append(own[on])
            bounds.append(upper[on])
        docs, bounds = np.concatenate(docs), np.concatenate(bounds)
        order = np.argsort(-bounds, kind="stable")
        docs, bounds = docs[order], bounds[order]
        done, step = 0, 4 * best.top
        while done < len(docs) and bounds[done] >= best.least:
            some = docs[done : done + step]
            some = some[bounds[done : done + step] >= best.least]
            best.add(self.scores(some, terms, weight), self.missing[some], self.doc_id[some])
            done, step = done + step, min(2 * step, 1 << 14)
        return min(done, len(docs))


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of the index, as many as make a block."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            held += batch.slice(k, 1).to_pylist()
            if sum(x["total"] for x in held) >= BLOCK_TERMS:
                yield held
                held = []
    if held:
        yield held


def ranked_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """The best documents of a block of the query set, by the number of its row."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(x.text.encode() for x in rows)
    items = [np.unique(np.array(x, np.int64)) for x in vocabulary.texts]
    del vocabulary.texts
    index = stored(indexed(docs, spark.sparkContext.broadcast(vocabulary)), "index")
    shared = spark.sparkContext.broadcast((items, weights(index, len(vocabulary.number))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value
        weighted = []
        for own in items:
            own = own[known.weight[own] > 0]
            weighted.append((own, known.weight[own]))
        best = [Best(top) for _ in items]
        for some in gathered(batches):
            block = Block(some, known)
            for (terms, weight), own in zip(weighted, best, strict=True):
                if len(terms) and block.slices:
                    block.search(terms, weight, own)
        for k, own in enumerate(best):
            if len(own.score):
                columns = {
                    "item": pa.array(np.full(len(own.score), k)),
                    "doc_id": pa.array(own.doc_id, mask=own.missing),
                    "score": pa.array(own.score),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """The `top` documents of each row (key, text) of a query set: key, rank, doc_id and score."""
    spark = docs.sparkSession
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = None
    for rows in query_blocks(queries, key, ITEM_BYTES):
        found = ranked_block(docs, rows, top)
        # the filter on the rank lets each task send no more than `top` rows of an item
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        kind = queries.schema[key].dataType.simpleString()
        names = spark.createDataFrame([(k, x[key]) for k, x in enumerate(rows)], f"item long, _key {kind}")
        found = found.join(names, "item").select(F.col("_key").alias(key), "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out
