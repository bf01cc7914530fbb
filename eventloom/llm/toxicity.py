"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A document is cut into windows of `WINDOW` words, all of them; each is a bag of its words and their character n-grams,
so a misspelling that was never seen still shares most of its vectors with the word it stands for. The document's
score is that of its worst window: a few insults in a long text are not averaged away. In training, after one epoch
over all windows, a document's worst window stands for it. The sample is bounded as for the quality classifier.

Null and empty texts have no features and get the score of the bias; without any labelled row all scores are 0.5.
Repeated labels of a document count once, the largest; rows without label or id teach nothing. Repeated documents are
scored alike, an empty table gives an empty result, and columns other than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.llm import labelled
from eventloom.llm.subword import Model, Shape, Training

ROWS = 6_000
LONGEST = 32 << 10
THRESHOLD = 0.5
WINDOW = 4
SHAPE = Shape(window=WINDOW)
TRAINING = Training(weight=3.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return labelled.fit(docs, labels, "toxic", rows, LONGEST, SHAPE, TRAINING)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return labelled.score(docs, model, THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels and score every document."""
    return score(docs, fit(docs, labels))
