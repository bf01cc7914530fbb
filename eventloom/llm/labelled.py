"""Fitting a subword model to labelled documents and scoring all documents with it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import blocks, fold, texts_of
from eventloom.llm.subword import Model, Shape, Training, train
from eventloom.llm.words import encoded

FOLDS = 5
BLOCK_BYTES = 2 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold, those of the smallest hashes of their ids.

    The chosen ids are at most `rows` in number, so they are broadcast. A document of more than `longest` bytes is no
    example, so that the sample's size is bounded as well; it is scored whole like any other.
    """
    spoken = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    chosen = (
        spoken.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = texts_of(docs).where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, shape: Shape, how: Training) -> Model:
    """Train on the bounded sample."""
    examples = sample(docs, labels, label, rows, longest).toArrow().sort_by("doc_id")
    truth = np.array(examples.column("label").to_pylist(), dtype=np.int64)
    return train(encoded(examples.column("text")), (truth > 0).astype(np.int64), shape, how)


def chances(model: Model, texts: list[bytes]) -> np.ndarray:
    """The probability of class 1 of each text."""
    return 1 / (1 + np.exp(-np.clip(model.log_odds(texts), -500, 500)))


def kept(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows whose text reaches the threshold, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            fine = chances(shared.value, encoded(block.column("text"))) >= threshold
            yield from block.filter(pa.array(fine)).to_batches(max_chunksize=2_000)

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The probability of class 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the number of buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            chance = chances(shared.value, encoded(block.column("text")))
            out = {
                "doc_id": block.column("doc_id").combine_chunks(),
                "held_out": block.column("held_out").combine_chunks(),
                "score": pa.array(chance),
                "predicted": pa.array((chance >= threshold).astype(np.int32)),
            }
            yield from pa.table(out).to_batches(max_chunksize=10_000)

    texts = texts_of(docs).withColumn("held_out", fold("doc_id", FOLDS) == 0)
    return texts.mapInArrow(run, SCHEMA)
