"""Readers and writers of entity tables, truth, splits, outputs and samples."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY = StructType([StructField(n, StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(n, StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
# fixed values: headers of the two output files
HEADERS = {"matching": "source1_entity_id\tmatched_entity_ids", "candidates": "source1_entity_id\tcandidate_entity_ids"}


def read_tsv(spark: SparkSession, path: str, schema: StructType | None = None, blank: bool = False) -> DataFrame:
    """A tab-separated file with a header; inferred types without a schema; blank: null texts become ''."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.na.fill("") if blank else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A limited scan; the order makes it the same every time."""
    return df.orderBy(*order).limit(n)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id) from a text file with one id a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).filter("entity_id <> ''")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def header_matches(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether the first line of every file is the output's header; a path without a line has none."""
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("line", "at").alias("line"))
    bad, files = first.agg(F.count(F.when(F.col("line") != HEADERS[kind], 1)), F.count("*")).first()
    return files > 0 and bad == 0


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; an empty text is an empty field."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(path)


def append_tsv(df: DataFrame, path: str, *order: str) -> None:
    """df's rows, in order, at the end of one tab-separated file; a new file begins with the header.

    The rows are sorted and written by the executors; the driver's file system copies the parts behind
    what is there into a new file, block by block, and puts it in the place of the old one.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path_ = jvm.org.apache.hadoop.fs.Path
    target, parts, fresh = Path_(path), Path_(f"{path}.parts"), Path_(f"{path}.new")
    fs = target.getFileSystem(conf)
    df.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("emptyValue", "").option("nullValue", "").option("quote", "").csv(parts.toString())
    files = sorted((s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    out = fs.create(fresh, True)
    try:
        if not fs.exists(target):
            out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
        for file in [*([target] if fs.exists(target) else []), *files]:
            given = fs.open(file)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, conf, False)
            given.close()
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(fresh, target)
    fs.delete(parts, True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(parts: DataFrame, path: str) -> dict[str, str]:
    """train and val ids (entity_id, split), sorted, one a line."""
    paths = {}
    for name in ("train", "val"):
        paths[name] = f"{path}/{name}_ids"
        parts.filter(F.col("split") == name).select("entity_id").orderBy("entity_id").write.mode("overwrite").text(paths[name])
    return paths


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_ids(spark, f"{path}/train_ids"), read_ids(spark, f"{path}/val_ids")


def nested_samples(s1: DataFrame, pairs: DataFrame, externals: DataFrame) -> DataFrame:
    """Each entity of s1 with an array of its matches' records. pairs: (source1_entity_id, candidate_entity_id)."""
    fields = ["entity_id", "business_name", "business_address", "country"]
    found = pairs.join(externals.select(F.col("entity_id").alias("candidate_entity_id"), *fields[1:]), "candidate_entity_id", "left")
    record = F.struct(F.col("candidate_entity_id").alias("entity_id"), *fields[1:])
    lists = found.groupBy("source1_entity_id").agg(F.array_sort(F.collect_list(record)).alias("matches"))
    return s1.select(*fields).join(lists, F.col("entity_id") == F.col("source1_entity_id"), "left").drop("source1_entity_id")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; of a larger one the first rows, and a line that says so."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    found = rows.limit(most + 1).collect()
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in found[:most]]
    if len(found) > most:
        lines += ["", f"First {most} rows; the result has more."]
    return "\n".join(lines) + "\n"


def package(name: str, files: dict[str, str], folder: str) -> str:
    """Local files under their names in a zip file."""
    out = Path(folder) / f"{name}.zip"
    out.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for inside, path in files.items():
            archive.write(path, inside)
    return str(out)
