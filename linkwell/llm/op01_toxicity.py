"""Query op1: toxicity of every document.

Subword-bag embeddings averaged into a linear softmax (see subword.py), on lower-cased words, so a
misspelt word shares character n-gram vectors with the one it stands for. Cases: a null or empty
text gets the constant's score; without labels every score is 0.5; texts of any length are read whole;
repeated rows are scored alike; a score of exactly 0.5 is predicted 1; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .subword import Shape, classify

SHAPE = Shape(chars=(4, 5), lower=True, distinct=True, prior=600)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, fold(F.col("doc_id"), 5) == 0, "toxic", SHAPE)


QUERIES = {"op1_toxicity": op1_toxicity}
