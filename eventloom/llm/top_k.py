"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

Vectors are brought to whole numbers, floor(scale * x), so that scores are exact. One distributed pass sums their Gram
matrix, whose size depends on the dimension alone; its eigenvectors rotate all vectors so that the first few
coordinates carry most of the length. Vectors are dealt into blocks by descending length, queries into blocks by hash.

First the queries meet the block of the longest vectors, which gives each a threshold, its k-th best score there. Then
every query block meets the vector blocks, longest first: a vector block whose longest vector can't reach any threshold
of the query block (|q| * |c| by Cauchy-Schwarz) is left out before anything is shuffled; in a block, the partial sum
over the leading rotated coordinates plus the product of the residual lengths bounds each score, and only pairs whose
bound reaches the threshold are scored, on whole numbers. All bounds have a margin above rounding, so nothing is lost.

Vectors that are null, or hold null or non-finite components, take no part; nor do empty ones. Vectors of fewer
dimensions count as filled up with zeros. Scores must fit a long. Equal scores go to the
smaller id; a repeated id counts as several candidates, none of which answers a query of its own id. A null id takes no
part. Queries with fewer than k candidates get them all. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import stored

#: Vectors in a block of candidates, and of queries.
BLOCK = 8192
QUERIES = 2048
LEADING = 0.25
SCORES = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (id, v): the vectors that take part, as whole numbers."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """List column as a matrix, short vectors filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dimension))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, dimension: int) -> np.ndarray:
    """The eigenvectors of the Gram matrix, the strongest first: the right singular vectors of all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dimension, dimension))
        for batch in batches:
            m = matrix(batch.column("v"), dimension)
            gram += m.T @ m
        rows, values = np.arange(dimension), gram.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(values, pa.list_(pa.float64()))], ["i", "g"])

    parts = vectors.select("v").mapInArrow(run, "i long, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g"))
    gram = np.zeros((dimension, dimension))
    for row in cells.collect():  # dimension squared numbers, however many vectors
        gram[row.i, row.j] = row.g
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def in_blocks(vectors: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows (block, id, v, norm), blocks of about so many vectors by descending length; and a bound on their numbers."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    many = max(1, -(-vectors.count() // block))
    rows = vectors.withColumn("norm", norm).repartitionByRange(many, F.desc("norm"), "id")
    numbered = stored(rows.withColumn("block", F.spark_partition_id()), "vectors")
    return numbered, (numbered.agg(F.max("block")).first()[0] or 0) + 1


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors, k  # a candidate below its query's floor can't be among the best
        self.query = self.vec = self.score = np.empty(0, dtype=np.int64)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec = np.concatenate([self.query, query]), np.concatenate([self.vec, vec])
        score = np.concatenate([self.score, score])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.searchsorted(query, query)
        keep = np.arange(len(query)) - starts < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        full = np.arange(len(query)) - starts == self.k - 1
        self.floors[query[full]] = np.maximum(self.floors[query[full]], score[full])


def search(queries: dict, vectors: dict, turn: np.ndarray, k: int, step: int = 1024) -> Best:
    """The best of one block of vectors for one block of queries; both hold id, m (a matrix) and norm."""
    dimension = turn.shape[1]
    lead = max(1, int(np.ceil(LEADING * dimension)))
    best = Best(queries["floor"].copy(), k)
    order = np.lexsort((vectors["id"], -vectors["norm"]))
    ids, norms, m = vectors["id"][order], vectors["norm"][order], vectors["m"][order]
    q, lengths = queries["m"], queries["norm"]
    turned = q @ turn
    rest = np.sqrt(np.maximum(0, (turned[:, lead:] ** 2).sum(1)))
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * dimension
    if largest >= 2**53:  # beyond what doubles hold exactly
        q, m_exact = q.astype(np.int64).astype(object), m.astype(np.int64).astype(object)
    else:
        m_exact = m
    for i in range(0, len(ids), step):
        own, far = m[i : i + step], norms[i : i + step]
        slack = 1e-9 * lengths * (far[0] + 1) + 0.5
        use = np.flatnonzero(lengths * far[0] >= best.floors - slack)
        if not len(use):
            break  # vectors only get shorter
        part = own @ turn
        bound = turned[use, :lead] @ part[:, :lead].T
        bound += rest[use, None] * np.sqrt(np.maximum(0, (part[:, lead:] ** 2).sum(1)))[None, :]
        hope = bound >= (best.floors - slack)[use, None]
        hope &= queries["id"][use, None] != ids[i : i + step][None, :]
        some = np.flatnonzero(hope.any(axis=1))
        if not len(some):
            continue
        scores = (q[use[some]] @ m_exact[i : i + step].T).astype(np.int64)
        scores[~hope[some]] = np.iinfo(np.int64).min
        if scores.shape[1] > k:  # the k-th best here is a floor already
            floor = np.partition(scores, -k, axis=1)[:, -k]
        else:
            floor = np.full(len(some), np.iinfo(np.int64).min)
        floor = np.maximum(floor.astype(np.float64), best.floors[use[some]])
        row, column = np.nonzero((scores >= floor[:, None]) & hope[some])
        best.add(use[some][row], ids[i : i + step][column], scores[row, column])
    return best


def met(queries: DataFrame, vectors: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """The best of each block of vectors for each query; both sides hold block and part, and meet where these agree."""
    shared = queries.sparkSession.sparkContext.broadcast(turn)  # dimension squared numbers

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        turn = shared.value
        sides = [
            {
                "id": x.column("id").to_numpy(),
                "m": matrix(x.column("v"), turn.shape[0]),
                "norm": x.column("norm").to_numpy(),
            }
            for x in (left, right)
        ]
        if not left.num_rows or not right.num_rows:
            best = Best(np.empty(0), k)
            names = np.empty(0, dtype=np.int64)
        else:
            best = search(sides[0] | {"floor": left.column("floor").to_numpy()}, sides[1], turn, k)
            names = sides[0]["id"]
        return pa.table({"query_id": names[best.query], "vec_id": best.vec, "score": best.score})

    keys = ["block", "part"]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, SCORES)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all vectors for every vector whose id meets `is_query`."""
    whole = whole_numbers(vectors, scale)
    dimension = whole.agg(F.max(F.size("v"))).first()[0] or 1
    turn = rotation(whole, dimension)
    blocks, many = in_blocks(whole, block)
    asked = blocks.where(is_query(F.col("id"))).drop("block")
    parts = max(1, -(-asked.count() // queries))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    lowest = F.lit(float("-inf"))
    first = blocks.where("block = 0").withColumn("part", every)
    found = stored(met(asked.withColumns({"block": F.lit(0), "floor": lowest}), first, turn, k), "best")
    if many > 1:
        floors = ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        asked = stored(asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", lowest)), "queries")
        # what length a vector needs to be of use to a query block, and how long each block's vectors are
        need = F.when(F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(lowest)
        needs = asked.groupBy("part").agg(F.min(need).alias("need"))
        lengths = blocks.where("block > 0").groupBy("block").agg(F.max("norm").alias("longest"))
        pairs = lengths.withColumn("part", every).join(needs, "part")
        pairs = stored(pairs.where("longest * 1.000001 + 1 >= need").select("block", "part"), "pairs")
        rest = met(asked.join(pairs, "part"), blocks.where("block > 0").join(pairs, "block"), turn, k)
        found = found.union(rest)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
