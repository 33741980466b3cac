"""A training-data pipeline over the documents table, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. language: documents whose language cannot be told (no letter, or hardly better than chance) go.
   Without a single labelled document no language is known and nothing goes.
2. near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more of their five-word
   shingles, the one with the least doc_id stays; rows with one doc_id count as one document, of
   which the row with the least text stays; rows without a doc_id stay.
3. decontamination: documents that cover a benchmark item go.
4. personal_data: spans are masked in the text, and n_chars follows where a text changed.
5. packing: what is left, as pieces of token sequences.

Null or empty texts pass stages 2 to 4 unchanged, but stage 1 drops them as they have no letter. An
empty table gives an empty result. Extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwell.llm import decontaminate, jaccard_join, langid, packing, pii
from linkwell.llm.common import maybe_among, stage, table
from linkwell.llm.op09_packing import tokenizer_path

LEAST_OVER_CHANCE = 1.2  # a language's least score, as a multiple of 1 / number of languages


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(langid.sampled(docs, "doc_id", "text", "lang"))
    if not net.langs:
        return docs
    lang, score = _unused(docs, "__lang"), _unused(docs, "__score")
    told = langid.predict(docs, net, out=(lang, score))
    least = min(1.0, LEAST_OVER_CHANCE / len(net.langs))
    return told.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, k=5, num=80, den=100)
    each = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("__kept"), F.count("*").alias("__rows"))
    touched = stage(each.filter("not __kept or __rows > 1").select("__id", "__kept"), "touched")
    maybe = _unused(docs, "__maybe")
    asked = maybe_among(docs, "doc_id", touched.select("__id"), maybe)
    sure, rest = asked.filter(~F.col(maybe)).select(*docs.columns), asked.filter(maybe).select(*docs.columns)
    out = sure.union(rest.join(touched, F.col("doc_id") == F.col("__id"), "left_anti"))
    again = touched.filter("__kept")
    if again.isEmpty():
        return out
    place = _unused(docs, "__place")
    repeated = rest.join(again, F.col("doc_id") == F.col("__id"), "left_semi")
    first = repeated.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(place) == 1)
    return out.union(first.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = _unused(docs, "__before")
    out = pii.masked(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text") != F.col(before), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

# SQL cannot run a trained network or a tokenizer; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
