"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet to the shared folder, and read again. All but
the last return the columns of documents. The three that remove repeats tell rows apart by doc_id and text, not by
doc_id alone, so that copies go also where they share a doc_id or have none. The first stage is learned, so SQL can't give the result.

As a stage begins when the result of the one before has been written, it first deletes the intermediates that the
earlier one left in the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from eventloom.llm.shared import delete, documents, recorded, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def staged(stage: Stage) -> Stage:
    """Have a stage begin with deleting what the one before has left."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with recorded() as paths:
            result = stage(spark, docs, sf_dir)
        _left[:] = paths
        return result

    return run_stage


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@staged
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


@staged
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, one of each group stays."""
    return jaccard.one_of_each(docs)


@staged
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are cut out."""
    return suffix_dedup.by_row(docs)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenized and packed into sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
