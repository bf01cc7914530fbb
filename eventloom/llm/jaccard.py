"""Near duplicates by a Jaccard join on word n-grams, with PartEnum signatures.

Sets of a and b shingles link when 100 * |intersection| >= percent * |union|, that is when they differ in at most
(a + b) * (100 - percent) / (100 + percent) shingles. Sizes are cut into bands, each reaching so far into the next that
any two sets that may link share a band. A band that bounds the difference by k divides the shingle domain, by hash,
into k + 1 + spare partitions: two sets that link agree in at least 1 + spare of them, so that they share a signature,
the hash of a set's shingles in one partition. A set with more than `spare` empty partitions also signs its empty ones.
No link is lost.

1. `members`: each document's set size and key, a 64-bit hash of its whole set. Equal sets are one class from here on.
2. Signatures are made where documents are read, once per class and block. A signature that several classes of a block
   share is known to be shared; else only one class per block and signature is sent, so that a hot signature brings a
   reducer no more records than there are blocks.
3. `groups`: classes that share a signature; of groups with the same classes one is kept. Large groups are cut into
   chunks, and pairs of chunks are compared in blocks. Parity sketches, a bit per hash with the parity of the set's
   shingles there, bound the difference of two sets from below, so they rule out pairs without loss.
4. Three rounds of exact verification on whole sets, with components formed after each. First a class takes part in its
   `FEW` largest groups only, each chunk of which gives a forest of its closest pairs: no more than `FEW` pairs for each
   class. Then all groups and all pairs of chunks give a forest between the components that they hold; a group whose
   classes are one component by now gives none. Last comes whatever is left between different components. So as long as
   what the sketches let pass also links, the pairs grow with the classes, not with the square of a group.

Shingles and sets are told apart by 64-bit hashes. A document with fewer words than a shingle has one shingle, all its
words; one without words (null, empty or white space) has none and links with nothing. Repeated rows and equal texts
are one class. A null doc_id takes part, but names no component if another document is there. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.graph import components
from eventloom.llm.shared import MARKS, blocks, chosen, marked, stored, texts_of
from eventloom.llm.words import encoded, mix, words

BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Classes of a group that are compared at once.
CHUNK = 512
BAND = 1.5
#: Groups that a class takes part in in the first round.
FEW = 2
ODD = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, counts = words(texts)
    ends = np.cumsum(counts)
    grams = mix(hashes + np.uint64(width))
    for _ in range(width - 1):
        grams = mix(grams[:-1] * ODD + hashes[len(hashes) - len(grams) + 1 :]) if len(grams) else grams
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(grams[end - n : end - width + 1]))
        elif n:
            one = mix(hashes[end - n : end - n + 1] + np.uint64(n << 32))
            for k in range(1, n):
                one = mix(one * ODD + hashes[end - n + k : end - n + k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_key(own: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    total = mix(own * ODD).sum(dtype=np.uint64) if len(own) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(own))]))[0].view(np.int64))


class Bands:
    """The size bands for a similarity in percent."""

    def __init__(self, percent: int):
        if not 0 < percent < 100:
            raise ValueError("percent must lie between 0 and 100")
        self.percent = percent
        self.edges = [-(-percent // (100 - percent))]  # smaller sets link only when equal

    def difference(self, sizes: int | np.ndarray) -> int | np.ndarray:
        """How many shingles two sets that link differ in at most, by the sum of their sizes."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Number, partitions and spare ones of each band that a set of n shingles takes part in."""
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        for j in range(len(self.edges) - 2, -1, -1):
            top = self.edges[j + 1] - 1
            reach = top * 100 // self.percent
            if n > reach:
                return
            if n >= self.edges[j]:
                k = self.difference(top + reach)
                spare = 2 + -(-k // 8)
                yield j, k + 1 + spare, spare

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """One signature for each partition of each band of a set."""
        out = [np.empty(0, dtype=np.uint64)]
        for j, partitions, spare in self.of(len(own)):
            part = ((own >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)  # ascends, as the set does
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.add.reduceat(mix(own), starts)
            out.append(mix(sums + part[starts] * ODD + np.uint64(j * 0x51_7C_C1)))
            if partitions - len(starts) > spare:
                empty = np.setdiff1d(np.arange(partitions, dtype=np.uint64), part[starts])
                out.append(mix(empty * ODD + np.uint64(j * 0x51_7C_C1 + (1 << 60))))
        return np.concatenate(out)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the set's shingles by hash; twice as many bits as shingles, in a power of two."""
    bits = max(512, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((mix(own ^ ODD) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def members(docs: DataFrame, width: int, marks: bool = False) -> DataFrame:
    """Per document: the size of its set, and its class (null for an empty set); with its marks, if asked for."""
    more = MARKS if marks else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            sets = shingle_sets(encoded(block.column("text")), width)
            out = {
                "doc_id": block.column("doc_id").combine_chunks(),
                "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "key": pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()),
            }
            out |= {x: block.column(x).combine_chunks() for x in more}
            yield from pa.table(out).to_batches(max_chunksize=10_000)

    texts, schema = texts_of(docs), "doc_id long, n_shingles long, key long"
    if marks:
        texts, schema = marked(texts).select("_row.*", *MARKS), f"{schema}, _null boolean, _id long, _digest binary"
    return texts.mapInArrow(run, schema)


def shared_signatures(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Rows (sig, key): the classes of every signature that several classes share."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for block in blocks(batches, BLOCK_BYTES):
            classes = {set_key(x): x for x in shingle_sets(encoded(block.column("text")), width) if len(x)}
            signed = [np.unique(bands.signatures(x)) for x in classes.values()]
            keys = np.repeat(np.fromiter(classes, np.int64, len(classes)), [len(x) for x in signed])
            sigs = np.concatenate([np.empty(0, np.uint64), *signed])
            order = np.lexsort((keys, sigs))
            sigs, keys = sigs[order], keys[order]
            first = np.ones(len(sigs), dtype=bool)
            first[1:] = sigs[1:] != sigs[:-1]
            twin = ~first
            twin[:-1] |= ~first[1:]
            yield from packed(sigs[twin], keys[twin], buckets, known=True)
            yield from packed(sigs[first], keys[first], buckets, known=False)

    def meet(rows: pa.Table) -> pa.Table:
        known = np.array(rows.column("known").to_pylist(), dtype=bool)
        parts = [[np.frombuffer(x, np.uint64) for x in rows.column(c).to_pylist()] for c in ("sigs", "keys")]
        flags = np.repeat(known, [len(x) for x in parts[0]])
        sigs, keys = (np.concatenate(x) for x in parts)
        fresh, fresh_keys = sigs[~flags], keys[~flags]
        order = np.lexsort((fresh_keys, fresh))
        fresh, fresh_keys = fresh[order], fresh_keys[order]
        new = np.ones(len(fresh), dtype=bool)
        new[1:] = (fresh[1:] != fresh[:-1]) | (fresh_keys[1:] != fresh_keys[:-1])
        fresh, fresh_keys = fresh[new], fresh_keys[new]
        again = np.zeros(len(fresh), dtype=bool)
        again[1:] = fresh[1:] == fresh[:-1]
        again[:-1] |= again[1:]
        sigs = np.concatenate([sigs[flags], fresh[again]])
        keys = np.concatenate([keys[flags], fresh_keys[again]])
        return pa.table({"sig": pa.array(sigs.view(np.int64)), "key": pa.array(keys.view(np.int64))})

    sent = texts_of(docs).select("text").mapInArrow(sign, "bucket int, known boolean, sigs binary, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "sig long, key long").distinct()


def packed(sigs: np.ndarray, keys: np.ndarray, buckets: int, known: bool) -> Iterator[pa.RecordBatch]:
    """A row per bucket. Known ones only pass through, so they are spread by class rather than by signature."""
    which = (mix(keys.view(np.uint64) ^ sigs) if known else sigs) % np.uint64(buckets)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(buckets + 1))
    rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    out = {
        "bucket": pa.array([b for b, _ in rows], pa.int32()),
        "known": pa.array([known] * len(rows), pa.bool_()),
        "sigs": pa.array([sigs[at].tobytes() for _, at in rows], pa.binary()),
        "keys": pa.array([keys[at].tobytes() for _, at in rows], pa.binary()),
    }
    yield from pa.table(out).to_batches(max_chunksize=64)


def sets_of(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Size, sketch and shingles of every class in a group, from its document of the smallest id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES // 4):
            sets = shingle_sets(encoded(block.column("text")), width)
            out = {
                "key": pa.array([set_key(x) for x in sets], pa.int64()),
                "n": pa.array([len(x) for x in sets], pa.int64()),
                "sketch": pa.array([sketch(x) for x in sets], pa.binary()),
                "shingles": pa.array([x.tobytes() for x in sets], pa.binary()),
            }
            yield from pa.table(out).to_batches(max_chunksize=500)

    needed = groups.select("key").distinct()
    chosen = classes.join(needed, "key").select(F.col("first").alias("_doc"))
    texts = texts_of(docs).join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc")))
    sets = texts.mapInArrow(run, "key long, n long, sketch binary, shingles binary")
    return sets.dropDuplicates(["key"])


def largest_groups(groups: DataFrame) -> DataFrame:
    """Of each class, the `FEW` groups that most classes share."""
    sizes = stored(groups.groupBy("sig").agg(F.count("*").alias("m")), "sizes")
    # a class has few hundred at most
    largest = F.slice(F.sort_array(F.collect_list(F.struct("m", "sig")), asc=False), 1, FEW).alias("_largest")
    own = groups.join(sizes, "sig").groupBy("key").agg(largest)
    return stored(own.select(F.explode("_largest.sig").alias("sig"), "key"), "largest")


def close_pairs(
    groups: DataFrame, sets: DataFrame, bands: Bands, roots: DataFrame | None = None, forest: bool = True
) -> DataFrame:
    """Pairs (a, b) of classes of a group that their sizes and sketches allow to link.

    Without `roots`, of each chunk only a forest of the closest pairs, and none between chunks. With them, pairs between
    different components in all pairs of chunks: a forest of components, or all.
    """
    members_ = groups.join(sets.select("key", "n", "sketch"), "key")
    if roots is None:
        members_ = members_.withColumn("root", F.col("key"))
    else:
        members_ = members_.join(roots.withColumnRenamed("node", "key"), "key", "left")
        members_ = members_.withColumn("root", F.coalesce("root", "key"))
    # written first, so that the join has plain sides and adaptive execution can split a hot signature
    chunks = F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")
    sizes = members_.groupBy("sig").agg(chunks, F.min("root").alias("_low"), F.max("root").alias("_high"))
    sizes = stored(sizes.where("_low <> _high").select("sig", "chunks"), "sizes")
    members_ = members_.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("key", "sig"), "chunks").cast("int"))
    others = F.array("own") if roots is None else F.sequence(F.lit(0), F.col("chunks") - 1)
    members_ = members_.withColumn("other", F.explode(others))
    members_ = members_.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, ("sig", "low", "high")):
            found = [x for group in some if (x := allowed(group, bands, forest)) is not None]
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    columns = ["sig", "low", "high", "own", "key", "root", "n", "sketch"]
    sorted_ = members_.select(*columns).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high", "key")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterable[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[dict]]:
    """Sorted rows as lists of whole groups, columns by name; a group may begin in one batch and end in another."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        ids = np.stack([table.column(c).to_numpy() for c in by])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        rest = table.slice(int(cuts[-1]) if len(cuts) else 0)
        if len(cuts):
            yield split(table.slice(0, int(cuts[-1])), [0, *cuts.tolist()])
    if rest is not None and rest.num_rows:
        yield split(rest, [0, rest.num_rows])


def split(table: pa.Table, cuts: list[int]) -> list[dict]:
    table = table.combine_chunks()
    columns = {c: table.column(c).to_numpy() for c in table.column_names if c != "sketch"}
    columns["sketch"] = table.column("sketch").to_pylist()
    return [{c: x[a:b] for c, x in columns.items()} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def allowed(group: dict, bands: Bands, forest: bool) -> np.ndarray | None:
    """The pairs of a group (or of two chunks of one) that may link; with `forest`, enough of them to connect its roots."""
    m = len(group["key"])
    if m < 2:
        return None
    size = min(map(len, group["sketch"]))
    bits = np.stack([folded(x, size) for x in group["sketch"]])
    n, key, root, own = group["n"], group["key"], group["root"], group["own"]
    across = group["low"][0] != group["high"][0]
    step = max(1, (16 << 20) // (m * size))
    found = []
    for i in range(0, m - 1, step):
        a = slice(i, i + step)
        apart = np.bitwise_count(bits[a, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
        near = apart <= bands.difference(n[a, None] + n[None, :])
        near &= 100 * np.minimum(n[a, None], n[None, :]) >= bands.percent * np.maximum(n[a, None], n[None, :])
        near &= root[a, None] != root[None, :]
        if across:
            near &= own[a, None] != own[None, :]
        left, right = np.nonzero(np.triu(near, i + 1))
        found.append(np.stack([apart[left, right], left + i, right], 1))
    pairs = np.concatenate(found)
    if forest:
        pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
        names, of = np.unique(root, return_inverse=True)
        parent, of = list(range(len(names))), of.tolist()
        kept = []
        for at, (_, x, y) in enumerate(pairs.tolist()):
            x, y = top(parent, of[x]), top(parent, of[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(at)
        pairs = pairs[kept]
    a, b = key[pairs[:, 1]], key[pairs[:, 2]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def top(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def folded(parities: bytes, size: int) -> np.ndarray:
    """A sketch brought to fewer bits."""
    bits = np.frombuffer(parities, dtype=np.uint64)
    while 8 * len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, of: DataFrame, width: int, percent: int) -> DataFrame:
    """Per class: its smallest doc_id, and a class that names its component. `of`: the members, written."""
    bands = Bands(percent)
    classes = stored(of.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first")), "classes")
    total = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = stored(shared_signatures(docs, width, percent, max(16, total // BUCKET_BYTES)), "signatures")
    content = [F.count("*").alias("m"), F.sum(F.xxhash64("key") % (1 << 40)).alias("h"), F.bit_xor("key").alias("x")]
    one = shared.groupBy("sig").agg(*content).groupBy("m", "h", "x").agg(F.min("sig").alias("sig")).select("sig")
    groups = stored(shared.join(one, "sig", "left_semi"), "groups")
    sets = stored(sets_of(docs, classes, groups, width), "sets")
    links = stored(verified(stored(close_pairs(largest_groups(groups), sets, bands), "pairs"), sets, percent), "verified")
    for forest in (True, False):
        roots = components(links)
        more = verified(stored(close_pairs(groups, sets, bands, roots, forest), "pairs"), sets, percent)
        links = links.union(stored(more, "verified"))
    roots = components(links)
    placed = classes.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return placed.withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per document: the size of its set, and the smallest doc_id that links lead to, itself included."""
    of = stored(members(docs, width), "members")
    placed = linked(docs, of, width, percent)
    # the aggregates are written, so that both joins have plain sides and a hot class or component can be split
    smallest = stored(placed.groupBy("root").agg(F.min("first").alias("_first")), "smallest")
    answers = stored(placed.join(smallest, "root").select("key", "_first"), "answers")
    return of.join(answers, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("_first", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, null last, and then the smallest digest.

    Rows without words link with nothing and stay, but one of those that repeat doc_id and text.
    """
    of = stored(members(docs, width, marks=True), "members")
    first = F.min(F.struct(*MARKS)).alias("first")
    classes = stored(of.where("key IS NOT NULL").groupBy("key").agg(first), "firsts")
    placed = linked(docs, of, width, percent).select("key", "root")
    kept = placed.join(classes, "key").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return chosen(docs, kept.union(of.where("key IS NULL").select(MARKS)))
