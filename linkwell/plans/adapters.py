"""Entities out of the documents table: a name, an address, a country and a truth table.

A document is an entity of source 1, 2 or 3 by its id; its name is its first six words, its address
the next fourteen with a six-digit code. Entities of one country whose texts are equal but for case
and blanks match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.operators.normalize import add_phonetic, normalize_entities


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    code = (F.col("doc_id") % 900 + 100000).cast("string")
    return (
        documents(spark, sf_dir)
        .withColumn("w", words)
        .select(
            F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
            F.array_join(F.slice("w", 1, 6), " ").alias("business_name"),
            F.concat_ws(" ", F.array_join(F.slice("w", 7, 14), " "), code).alias("business_address"),
            F.col("lang").alias("country"),
            F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")).cast("binary")).alias("text_key"),
        )
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_phonetic(normalize_entities(entities(spark, sf_dir)))


def source(rows: DataFrame, *numbers: int) -> DataFrame:
    return rows.filter(F.substring("entity_id", 1, 2).isin([f"S{n}" for n in numbers]))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir).select("entity_id", "country", "text_key")
    s1 = source(rows, 1).select(F.col("entity_id").alias("source1_entity_id"), "country", "text_key")
    ext = source(rows, 2, 3).groupBy("country", "text_key").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("m"))
    return s1.join(ext, ["country", "text_key"], "left").select("source1_entity_id", F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
