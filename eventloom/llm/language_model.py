"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The vocabulary is factored into classes of classes: a tree with up to 16 branches at each node, so that a token is a path
of nodes, and its probability, given the tokens before it, is the product of one softmax over the branches of each node.
Every softmax on the path depends on the context, down to the token itself.

* Tree: the `FREQUENT` most frequent tokens are leaves of a Huffman tree by their counts, one leaf of which stands for all
  other tokens. Below that one, tokens part by the digits of their hash, as many as leave about `LEAF` of them together; so
  the tree is as deep as the vocabulary asks for. Token counts are gathered from all training documents, combined in each
  block before the shuffle. Tokens that share a leaf have their share of its count, after a share for unknown tokens that
  is the share of tokens seen once among those that are not frequent (all unknown tokens of a leaf are one event, as they
  are in the base score).
* Features: the last token (bigrams), and the one before it (skipping one). At each node, each is hashed to a row of
  weights, one per branch; the rows grow with the training tokens up to 2**`ROW_BITS[1]`, so that they may be broadcast. To
  them comes the logarithm of the branches' counts.

Weights are trained by distributed gradient updates: in each of `ROUNDS`, every task takes its part of the training
documents through sparse numpy batches, from the weights of the round before, and sends the change of the rows that it
touched; changes are averaged row by row. There are a few tasks per core, whatever the input, so what they send doesn't
grow with it. Every training document is used once and whole. For scoring, the documents are dealt into blocks by a hash
of their id and text, the distinct tokens of a block are joined with the counts of the corpus, and the answers meet the
block again.

Tokens are told apart by 62-bit hashes. Null and empty texts are the end token alone. Repeated rows are scored alike and,
where they train, count each. With no training documents at all, all tokens are unknown, which is certain. A null doc_id
counts as an empty text for the fold. An empty table gives an empty result; other columns are ignored. Of a very long text
no more is held than some 100 bytes a token.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import blocks, fold, stored, texts_of
from eventloom.llm.words import encoded, hashed, joined, mix, spans

FOLDS = 10
FREQUENT = 16_384
LEAF = 4
WIDTH = 16
#: Logarithms of the least and the greatest number of rows, and of the training tokens for each.
ROW_BITS = (15, 18)
TOKENS_PER_ROW = 5
ROUNDS = 2
BATCH = 4096
#: Nodes whose softmax is taken at once, so that their branches stay in a core's cache.
STEP = 2048
RATE = 0.5
BLOCK_BYTES = 8 << 20
#: Rows of weights that are summed together.
PART = 4096
#: Training tasks for each core.
TASKS_PER_CORE = 4
END = np.uint64(0xA5A5_0F0F_3C3C_9696)
START = np.uint64(0x5EED_5EED_5EED_5EED)
ODD = np.uint64(0x9FB21C651E98DF25)
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every token (words, then one end, of each text), and the number of tokens of each text."""
    data, begin = joined(texts)
    starts, ends = spans(data)
    counts = np.diff(np.searchsorted(starts, begin))
    return np.insert(hashed(data, starts, ends), np.cumsum(counts), END), counts + 1


def contexts(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each feature of each token's context, one line per kind of feature."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(token)) - np.repeat(first, counts)
    one, two = (np.where(place >= k, np.roll(token, k), START) for k in (1, 2))
    return np.stack([mix(one), mix(two * ODD)])


class Places:
    """Where some hashes stand in a sorted list of distinct ones; by their leading bits, as hashes spread evenly."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 1
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.start = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def of(self, some: np.ndarray) -> np.ndarray:
        """The place of each; the length of the list for those that are not in it."""
        bucket = (some >> self.shift).astype(np.int64)
        at, end = self.start.take(bucket), self.start.take(bucket + 1)
        out = np.full(len(some), len(self.hashes))
        left = np.flatnonzero(at < end)
        at, end, some = at.take(left), end.take(left), some.take(left)
        while len(left):
            same = self.hashes.take(at) == some
            out[left[same]] = at[same]
            at += 1
            on = np.flatnonzero(~same & (at < end))
            left, at, end, some = left.take(on), at.take(on), end.take(on), some.take(on)
        return out


def huffman(weights: list[int]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """The path (node, branch) of each symbol from the root, and the weight of each node's branches."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heap += [(0, -k) for k in range(1, 1 + -(len(weights) - 1) % (WIDTH - 1))]  # of no symbol, so that all nodes are full
    heapq.heapify(heap)
    parents: dict[int, tuple[int, int]] = {}
    nodes = []
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(WIDTH)]
        number = len(nodes)
        for branch, (_, k) in enumerate(some):
            parents[k] = (number, branch)
        nodes.append([w for w, _ in some])
        heapq.heappush(heap, (sum(nodes[-1]), len(weights) + number))
    paths = []
    for k in range(len(weights)):
        path = []
        while k in parents:
            path.append(parents[k])
            k = len(weights) + path[-1][0]
        paths.append(path[::-1])
    return paths, nodes


@dataclass
class Tree:
    """What the model knows of the corpus besides the counts of single tokens; of a bounded size."""

    total: int  # training tokens
    distinct: int
    unknown: float  # share of unknown tokens in each leaf of hashed tokens
    digits: int  # nodes on the path of a hashed token below the leaf that stands for all of them
    frequent: np.ndarray  # hashes of the frequent tokens, sorted, and a line behind them for all others
    depth: np.ndarray  # how many nodes lead to each of these
    node: np.ndarray  # the nodes, and the branches taken
    branch: np.ndarray
    prior: np.ndarray  # logarithm of the share of each branch of each node; a last line for nodes of hashed tokens

    @property
    def bits(self) -> int:
        return int(np.clip((self.total // TOKENS_PER_ROW).bit_length(), *ROW_BITS))

    @cached_property
    def places(self) -> Places:
        return Places(self.frequent)

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The paths of all lines one after the other: where each begins, the nodes, their hashes, the branches."""
        on = np.arange(self.node.shape[1]) < self.depth[:, None]
        node = self.node[on]
        return np.cumsum(self.depth) - self.depth, node, mix(node.astype(np.uint64)), self.branch[on]

    def line(self, token: np.ndarray) -> np.ndarray:
        """The line of each token in the tables: the last one for those that are not frequent."""
        return self.places.of(token)

    def paths(self, token: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every node on the tokens' paths: which token, the node's hash, its line of `prior`, and the branch taken."""
        begin, node, hashes, branch = self.steps
        each = self.depth.take(line)
        owner = np.repeat(np.arange(len(token)), each)
        at = (begin.take(line) - np.cumsum(each) + each).take(owner) + np.arange(len(owner))
        tail = np.flatnonzero(line == len(self.frequent))
        below = np.arange(self.digits, dtype=np.uint64)
        parts = token.take(tail)[:, None] >> (np.uint64(60) - np.uint64(4) * below)
        prefix = (parts >> np.uint64(4)) * ODD + (below + np.uint64(1 << 40))
        return (
            np.concatenate([owner, np.repeat(tail, self.digits)]),
            np.concatenate([hashes.take(at), mix(prefix.ravel())]),
            np.concatenate([node.take(at), np.full(parts.size, len(self.prior) - 1)]),
            np.concatenate([branch.take(at), (parts & np.uint64(15)).astype(np.int64).ravel()]),
        )

    def leaf(self, token):
        """The leaf of a hashed token, as its leading digits; also of a column."""
        return token >> np.uint64(64 - 4 * self.digits) if self.digits else token * np.uint64(0)


def token_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all training documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            words, n = np.unique(tokens(encoded(block.column("text")))[0], return_counts=True)
            columns = [pa.array(words.view(np.int64)), pa.array(n)]
            yield from pa.Table.from_arrays(columns, ["word", "n"]).to_batches(max_chunksize=20_000)

    training = texts_of(docs).where(fold("doc_id", FOLDS) != 0).select("text")
    return training.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tree(counts: DataFrame) -> Tree:
    """The tree of the corpus; at most FREQUENT tokens come to the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    once = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    total, distinct, single = counts.agg(F.sum("n"), F.count("*"), once).first()
    total, single = total or 0, single or 0
    others, other_total = distinct - len(top), total - sum(x.n for x in top)
    single -= sum(x.n == 1 for x in top)
    top.sort(key=lambda x: x.word % (1 << 64))
    paths, nodes = huffman([*(x.n for x in top), max(1, other_total)])
    depth = np.array([len(x) for x in paths])
    node, branch = (np.zeros((len(paths), max(1, depth.max())), np.int64) for _ in range(2))
    for k, path in enumerate(paths):
        for level, (a, b) in enumerate(path):
            node[k, level], branch[k, level] = a, b
    prior = np.zeros((len(nodes) + 1, WIDTH))
    for k, masses in enumerate(nodes):
        prior[k] = np.where(np.array(masses) > 0, np.log(np.maximum(masses, 1) / sum(masses)), -30)  # none for no symbol
    digits = 0
    while WIDTH**digits * LEAF < others:
        digits += 1
    unknown = float(np.clip((single + 0.1) / (other_total + 0.2), 1e-6, 0.5)) if others else 1.0
    frequent = np.array([x.word for x in top], dtype=np.int64).view(np.uint64)
    return Tree(total, distinct, unknown, digits, frequent, depth, node, branch, prior.astype(np.float32))


def shares(counts: DataFrame, own: Tree) -> DataFrame:
    """Rows (word, n, leaf_n): the counts of all training tokens, and of their leaves; a frequent one is a leaf itself."""
    most = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", F.lit(True).alias("_frequent"))
    marked = counts.join(most, "word", "left")
    leaf = F.shiftrightunsigned("word", 64 - 4 * own.digits) if own.digits else F.lit(0).cast("long")
    marked = stored(marked.select("word", "n", F.when(F.col("_frequent").isNull(), leaf).alias("leaf")), "leaves")
    sums = marked.where("leaf IS NOT NULL").groupBy("leaf").agg(F.sum("n").alias("leaf_n"))
    return marked.join(sums, "leaf", "left").select("word", "n", F.coalesce("leaf_n", "n").alias("leaf_n"))


def log_softmax(z: np.ndarray, weights: np.ndarray, prior: np.ndarray, line: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The logarithm of each softmax's sum; `z` becomes what it is the sum of the exponentials of, one line per node."""
    held = np.empty_like(z)
    np.take(prior, line, axis=0, out=z, mode="clip")
    for own in rows:
        z += np.take(weights, own, axis=0, out=held, mode="clip")
    if z.max(initial=0) > 60:
        np.minimum(z, 60, out=z)  # exponentials then fit into 32 bits, unless all are far below
    total = np.einsum("ij->i", np.exp(z, out=held))  # a matrix product would set many threads to work
    far = np.flatnonzero(total < 1e-30)
    if len(far):
        top = z[far].max(axis=1, keepdims=True)
        z[far] -= top
        total[far] = np.exp(z[far]).sum(axis=1)
    return np.log(total)


def in_lines(weights: np.ndarray) -> np.ndarray:
    """A copy whose rows each fill one line of the CPU's cache, rather than parts of two."""
    line = WIDTH * weights.itemsize
    room = np.empty(weights.nbytes + line, dtype=np.uint8)
    out = room[-room.ctypes.data % line :][: weights.nbytes].view(weights.dtype).reshape(weights.shape)
    out[:] = weights
    return out


def in_rows(weights: np.ndarray) -> np.ndarray:
    """The same weights, a row as one value."""
    return weights.view(f"V{WIDTH * weights.itemsize}").reshape(-1)


def rows_of(context: np.ndarray, owner: np.ndarray, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """The row of each feature at each node of a path."""
    shift = np.uint64(64 - bits)
    return [((kind.take(owner) ^ node) * ODD >> shift).astype(np.int64) for kind in context]


def summed(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows among `own`, and the sum of the lines of `p` that each stands beside."""
    key = np.sort(own << 32 | np.arange(len(own)))
    row, order = key >> 32, key & 0xFFFF_FFFF
    first = np.ones(len(key) + 1, dtype=bool)
    np.not_equal(row[1:], row[:-1], out=first[1:-1])
    starts = np.flatnonzero(first[:-1])
    sums = p.take(order.take(starts), axis=0)
    again = ~(first[:-1] & first[1:])  # in order, places whose row has others
    several = np.flatnonzero(again)
    if len(several):  # most rows have one line, so that only those of the others are added up
        group = np.cumsum(first.take(several)) - 1
        cell = (WIDTH * group[:, None] + np.arange(WIDTH)).reshape(-1)
        more = np.bincount(cell, p.take(order.take(several), axis=0).reshape(-1)).astype(np.float32)
        np.put(in_rows(sums), np.flatnonzero(again.take(starts)), in_rows(more.reshape(-1, WIDTH)))
    return row.take(starts), sums


def learn(
    weights: np.ndarray, squares: np.ndarray, used: np.ndarray, prior: np.ndarray, line: np.ndarray, rows: list[np.ndarray], truth: np.ndarray
) -> None:
    """One gradient update in place; places that share a row are summed before they are applied."""
    p = np.empty((len(truth), WIDTH), dtype=np.float32)
    for i in range(0, len(p), STEP):
        z = p[i : i + STEP]
        z -= log_softmax(z, weights, prior, line[i : i + STEP], [x[i : i + STEP] for x in rows])[:, None]
        np.exp(z, out=z)
    p.reshape(-1)[np.arange(0, p.size, WIDTH) + truth] -= 1
    for own in rows:
        touched, slope = summed(p, own)
        squared = squares.take(touched) + np.einsum("ij,ij->i", slope, slope)
        np.put(squares, touched, squared)
        np.put(used, touched, True)
        slope *= (RATE / np.sqrt(squared))[:, None]
        np.put(in_rows(weights), touched, in_rows(weights.take(touched, axis=0) - slope))


def batches_of_tokens(
    token: np.ndarray, sizes: np.ndarray, line: np.ndarray, own: Tree
) -> Iterator[tuple[np.ndarray, int, int, tuple]]:
    """Contexts, first token, its number of tokens, and paths, of some tokens at a time."""
    context = contexts(token, sizes)
    for i in range(0, len(token), BATCH):
        some = slice(i, i + BATCH)
        yield context[:, some], i, min(BATCH, len(token) - i), own.paths(token[some], line[some])


def trained(docs: DataFrame, own: Tree) -> np.ndarray:
    """The weights, after all rounds."""
    spark = docs.sparkSession
    shape = (1 << own.bits, WIDTH)
    weights = np.zeros(shape, dtype=np.float32)
    training = texts_of(docs).where(fold("doc_id", FOLDS) != 0)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, own))

        def update(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin, own = shared.value
            now = in_lines(begin)
            squares = np.ones(len(begin), dtype=np.float32)
            used = np.zeros(len(begin), dtype=bool)
            for block in blocks(batches, BLOCK_BYTES // 2):
                token, sizes = tokens(encoded(block.column("text")))
                for context, _, _, (owner, node, line, branch) in batches_of_tokens(token, sizes, own.line(token), own):
                    learn(now, squares, used, own.prior, line, rows_of(context, owner, node, own.bits), branch)
            for part in range(0, len(begin), PART):
                on = used[part : part + PART]
                if on.any():
                    change = (now[part : part + PART] - begin[part : part + PART]).astype(np.float16).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([change]), pa.array([np.packbits(on).tobytes()])],
                        ["part", "change", "used"],
                    )

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for part, change, used in zip(*(batch.column(x).to_pylist() for x in ("part", "change", "used")), strict=True):
                    change, used = np.frombuffer(change, np.float16), np.unpackbits(np.frombuffer(used, np.uint8))
                    if part not in sums:
                        sums[part] = [np.zeros(len(change)), np.zeros(len(used))]
                    sums[part][0] += change
                    sums[part][1] += used
            for part, (change, used) in sums.items():
                mean = (change.reshape(-1, WIDTH) / np.maximum(1, used)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()])], ["part", "change"])

        some = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text")
        some = some.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        changes = some.mapInArrow(update, "part int, change binary, used binary").repartition(shape[0] // PART, "part")
        weights = weights.copy()
        for row in changes.mapInArrow(add, "part int, change binary").collect():  # as large as the weights
            mean = np.frombuffer(row.change, np.float32).reshape(-1, WIDTH)
            weights[row.part : row.part + len(mean)] += mean
        shared.unpersist()
    return weights


def score_block(texts: list[bytes], known: dict[str, np.ndarray], weights: np.ndarray, own: Tree) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, base score and score.

    `known` has the sorted words of the block that training has seen, their counts and those of their leaves.
    """
    token, sizes = tokens(texts)
    text, line = np.repeat(np.arange(len(texts)), sizes), own.line(token)
    at = Places(known["word"]).of(token)
    seen = at < len(known["word"])
    # of each known word, and last of one that training has not seen
    n, leaf_n = (np.append(known[x], y).astype(np.float64) for x, y in (("n", 0), ("leaf_n", 1)))
    base = np.log10((n + 0.1) / (own.total + 0.1 * (own.distinct + 1)))
    share = np.log(np.where(n > 0, (1 - own.unknown) * np.maximum(n, 1) / leaf_n, own.unknown))
    score = np.where(line == len(own.frequent), share.take(at), 0.0)
    for context, first, many, (owner, node, place, branch) in batches_of_tokens(token, sizes, line, own):
        rows = rows_of(context, owner, node, own.bits)
        found = np.empty(len(owner), dtype=np.float32)
        for i in range(0, len(owner), STEP):
            some = slice(i, i + STEP)
            z = np.empty((len(owner[some]), WIDTH), dtype=np.float32)
            total = log_softmax(z, weights, own.prior, place[some], [x[some] for x in rows])
            found[some] = z.reshape(-1).take(np.arange(0, z.size, WIDTH) + branch[some]) - total
        score[first : first + many] += np.bincount(owner, found, many)
    count = len(texts)
    return {
        "n_tokens": sizes.astype(np.int64),
        "n_known": np.bincount(text, seen, count).astype(np.int64),
        "base_score": np.bincount(text, base.take(at), count),
        "score": np.bincount(text, score / np.log(10), count),
    }


def scored(docs: DataFrame, counts: DataFrame, own: Tree, weights: np.ndarray) -> DataFrame:
    """`counts` as from `shares`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weights, own))
    texts = texts_of(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-total // BLOCK_BYTES))
    # by the text as well, so that rows without an id, or of one id, don't fill a block
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("int"))

    def distinct(block: pa.Table) -> pa.Table:
        words = np.unique(tokens(encoded(block.column("text")))[0])
        number = block.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(words), number, np.int32)), "word": pa.array(words.view(np.int64))})

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        weights, own = shared.value
        order = np.argsort(words.column("word").to_numpy().view(np.uint64))
        known = {x: words.column(x).to_numpy()[order] for x in ("word", "n", "leaf_n")}
        known["word"] = known["word"].view(np.uint64)
        out = score_block(encoded(block.column("text")), known, weights, own)
        doc = block.column("doc_id").to_pylist()
        held = [zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS == 0 for x in doc]
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": out["n_tokens"],
                "n_known": out["n_known"],
                "train_tokens": np.full(len(doc), own.total, dtype=np.int64),
                "base_score": out["base_score"],
                "score": out["score"],
            }
        )

    words = texts.groupBy("block").applyInArrow(distinct, "block int, word long")
    known = words.join(counts, "word").select("block", "word", "n", "leaf_n")
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, SCORES)


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on all documents outside the held-out fold and score all."""
    counts = stored(token_counts(docs), "counts")
    own = tree(counts)
    return scored(docs, stored(shares(counts, own), "shares"), own, trained(docs, own))
