"""Query op3: quality of every document.

Learned hashed word, word-pair and character n-gram vectors averaged per document (see subword.py),
case kept, since junk shows in capitals and signs. Cases: a null or empty text gets the constant's
score; without labels every score is 0.5; texts of any length are read whole; repeated rows are
scored alike; a score of exactly 0.5 is predicted 1; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .subword import Shape, classify

SHAPE = Shape(chars=(2, 3, 4), word_ngrams=2, lower=False, prior=10)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, fold(F.col("doc_id"), 3) == 1, "quality", SHAPE)


QUERIES = {"op3_quality": op3_quality}
