"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled documents, chosen by a hash of the id among those that ``learn`` (over doc_id) admits.

    Null ids and null labels are no labels, nor are labels of ids that no document has: they
    don't use up the bound.  Of several labels of an id the largest counts; of several documents
    of an id the least text counts.
    """
    one = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    present = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    chosen = one.groupBy("doc_id").agg(F.max("y").alias("y")).where(learn).join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the labels' side has ``bound`` rows at most, and so has the result
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
