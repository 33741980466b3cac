"""Entities that arrive as files, matched batch by batch against static externals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkwell.sources.io import ENTITY


def entity_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Tab-separated entity files with a header, as they appear in a folder."""
    return spark.readStream.schema(ENTITY).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def match_stream(stream: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """match(batch) of every batch, written as Parquet under its batch number, so a repeated batch replaces itself.

    No state crosses batches: an entity lies whole in one batch and its candidates come from static tables.
    """

    def write(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
