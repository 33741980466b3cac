"""Query op2: documents that contain test items, with the share of each item that they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import leaks


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
