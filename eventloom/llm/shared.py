"""What the operators share: input columns, the shared folder, and work dealt out by size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read: doc_id as long and text, null as empty. Others don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: What tells rows apart: whether doc_id is null, doc_id, and the digest of the text.
MARKS = ["_null", "_id", "_digest"]


def marked(docs: DataFrame) -> DataFrame:
    """`MARKS`, which are never null, and the row as one struct `_row`, so that its columns clash with none.

    The order of marks is that of doc_id, null last, and of digests.
    """
    own = F.col("doc_id").cast("long")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
    return docs.select(own.isNull().alias("_null"), F.coalesce(own, F.lit(0)).alias("_id"), digest.alias("_digest"), row.alias("_row"))


def chosen(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose marks are there, with all their columns; of rows with the same marks, one."""
    # repeated rows go first, which combines before the shuffle; the join then needs no other shuffle of the texts
    return marked(docs).dropDuplicates(MARKS).join(marks.select(MARKS), MARKS, "left_semi").select("_row.*")


def free_name(frame: DataFrame, name: str) -> str:
    """A name that no column of the frame has, whatever its case."""
    taken = {x.lower() for x in frame.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_recorded: list[list[str]] = []


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The frame, written to the shared folder and read back: later steps neither repeat nor lose its work."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    if _recorded:
        _recorded[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that `stored` writes to meanwhile."""
    _recorded.append([])
    try:
        yield _recorded[-1]
    finally:
        _recorded.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove what `stored` has written, once all that reads it is written itself."""
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Arrow batches gathered, or cut, to about `size` bytes each; the order of rows stays."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            held.append(part)
            weight += part.nbytes
            if weight >= size:
                yield pa.Table.from_batches(held)
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


def batches_of(table: pa.Table, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    return iter(table.combine_chunks().to_batches(max_chunksize=rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id, parts: int):
    """CRC-32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts
