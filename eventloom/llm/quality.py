"""Quality classifier: supervised subword embeddings, averaged per document.

A document is one bag: the learned hashed vectors of its words, of their character n-grams and of its word pairs are
averaged, and a softmax gives the odds of label 1. Vectors and softmax are trained together by numpy stochastic
gradient descent on a bounded sample (`ROWS` labelled documents of up to `LONGEST` bytes, none of the held-out fold).
Examples of the rarer label 0 weigh more, so that a low score is needed to reject a document.

Letters keep their case, as junk is often told by it. Null and empty texts have no features and get the score of the
bias; without any labelled row all scores are 0.5. Repeated labels of a document count once, the largest; rows without
label or id teach nothing. Repeated documents are scored alike, an empty table gives an empty result, and columns other
than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.llm import labelled
from eventloom.llm.subword import Model, Shape, Training

ROWS = 6_000
LONGEST = 32 << 10
THRESHOLD = 0.3
SHAPE = Shape(lower=False, pairs=True)
TRAINING = Training(weight=0.1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return labelled.fit(docs, labels, "quality", rows, LONGEST, SHAPE, TRAINING)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return labelled.score(docs, model, THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels and score every document."""
    return score(docs, fit(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted to be of quality, with all their columns."""
    return labelled.kept(docs, fit(docs, labels), THRESHOLD)
