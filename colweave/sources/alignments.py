"""Alignments: derived from the ``part`` table, or read from files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the derived alignment.
ROWS = 8


def derived_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, col, ch: a deterministic alignment of ROWS rows with a column for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    each = part.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))))
    at = 1 + (F.col("p_size") * 7 + F.col("p_partkey") * 17) % 4
    letter = lambda s: F.substring(F.lit(s), at.cast("int"), F.lit(1))
    gap = (F.col("p_partkey") + 5 * F.col("j")) % 29 == 0
    other = (F.col("p_partkey") * (2 * F.col("j") + 3) + F.col("p_size") * (F.col("j") + 1)) % 23 == 0
    return each.select(F.col("j").cast("int").alias("seq_id"), F.col("p_partkey").cast("int").alias("col"), F.when(gap, "-").when(other, letter("CGTA")).otherwise(letter("ACGT")).alias("ch"))


def read_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """seq_id, seq: one aligned row a file, in the order of the list; gzip and block gzip by their extension.

    Rows of unequal length raise an error when the result is used.
    """
    order = spark.createDataFrame([(k, _uri(spark, p)) for k, p in enumerate(paths)], "seq_id int, file string")
    texts = spark.read.text(sorted(set(paths)), wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.regexp_replace("value", r"\s+$", "").alias("seq"))
    full = order.join(texts, "file").select("seq_id", "seq")
    size = full.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    checked = size.select(F.assert_true(F.col("lo") == F.col("hi"), "rows of unequal length").alias("ok"))
    return full.join(F.broadcast(checked), F.col("ok").isNull()).select("seq_id", "seq")  # one row


def _uri(spark: SparkSession, path: str) -> str:
    """The path as files name themselves when they are read."""
    full = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", full.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(full).toUri().toString())


def map_columns(rows: DataFrame, step: int, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, reverse: bool = False) -> DataFrame:
    """``function`` over batches of (seq_id, lb, chars): every row in ranges of ``step`` columns; with ``reverse`` each range backwards, the last one first."""
    ranges = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(step))
    cut = rows.select("seq_id", "seq", F.explode(F.reverse(ranges) if reverse else ranges).alias("lb"))
    chars = F.substring(F.col("seq"), F.col("lb") + 1, F.lit(step))
    return cut.select("seq_id", "lb", (F.reverse(chars) if reverse else chars).alias("chars")).mapInArrow(function, schema)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The rows named in a list file, one path a line, blank lines skipped."""
    names = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    return read_rows(spark, names)


def column_range(rows: DataFrame, lb: int, rb: int) -> DataFrame:
    """seq_id, seq: columns [lb, rb) of every row."""
    return rows.select("seq_id", F.substring("seq", lb + 1, rb - lb).alias("seq"))
