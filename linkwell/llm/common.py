"""Shared helpers: table reading, shared scratch storage, folds and Arrow plumbing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local run, whose driver and executors are one
    process, may leave it unset and gets a temporary folder; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="linkwell-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder then stays for the cluster's own cleaning
        pass


_registered: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a finished write drops its shuffle files at once


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if root not in _registered:
        _registered.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/scratch-" in folder:
            _drop(spark, folder)


WORDS = 1 << 18  # 64-bit words of a membership filter


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, out: str) -> DataFrame:
    """rows with out, false only where key surely is none of ids (of one column).

    A Bloom filter with one bit for each id, as a table of at most WORDS rows: its broadcast has that
    bound. With many more ids than bits it lets every row pass, so an exact join must follow.
    """
    (column,) = ids.columns
    code = lambda c: F.xxhash64(F.lit("among"), F.col(c).cast("bigint"))
    word, bit = (lambda c: F.pmod(code(c), F.lit(WORDS))), (lambda c: F.pmod(F.shiftrightunsigned(code(c), 32), F.lit(64)).cast("int"))
    hold = [f"{out}_{n}" for n in ("word", "bit", "bits")]
    marks = ids.select(word(column).alias(hold[0]), bit(column).alias(hold[1])).groupBy(hold[0]).agg(F.expr(f"bit_or(shiftleft(1L, {hold[1]}))").alias(hold[2]))
    rows = rows.withColumns({hold[0]: word(key), hold[1]: bit(key)}).join(F.broadcast(marks), hold[0], "left")
    return rows.withColumn(out, F.coalesce(F.expr(f"shiftrightunsigned({hold[2]}, {hold[1]}) & 1L") == 1, F.lit(False))).drop(*hold)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def filled(column: pa.Array, kind: pa.DataType = pa.string()) -> pa.Array:
    """column without nulls (empty instead), as one contiguous array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != kind:
        column = column.cast(kind)
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; null counts as empty."""
    column = filled(column, pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(column: pa.Array, most: int = 4 << 20):
    """Consecutive (first row, row count) slices of a string array of about `most` bytes each; a longer text is alone."""
    _, off = utf8(column)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, side="right")) - 1)
        yield first, last - first
        first = last


def runs(batches, keys: tuple[str, ...]):
    """(table, bounds) of whole runs of rows with equal keys, from batches that arrive sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            column = np.asarray(table.column(k))
            new |= column[1:] != column[:-1]
        bounds = np.flatnonzero(new) + 1
        done = int(bounds[-1]) if len(bounds) else 0
        if done:
            yield table.slice(0, done), np.concatenate(([0], bounds))
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])
