"""Aligned rows as cells, and the co-ordinate map between aligned and ungapped positions.

A cell is (seq_id, col, ch); ``nb`` counts the non-gap cells of its row before it, so the
k-th non-gap cell (from 0) is the one with nb = k and no gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a row that are counted in one task of a running sum.
STRETCH = 65_536


def with_rank(cells: DataFrame) -> DataFrame:
    """cells with nb. Running sums in two levels: totals of stretches, then places within one, so that no task holds a whole row."""
    kept = F.when(F.col("ch") != "-", 1).otherwise(0)
    cut = cells.withColumn("stretch", F.floor(F.col("col") / STRETCH))
    totals = cut.groupBy("seq_id", "stretch").agg(F.sum(kept).alias("n"))
    before = totals.select("seq_id", "stretch", (F.sum("n").over(Window.partitionBy("seq_id").orderBy("stretch")) - F.col("n")).alias("before"))
    own = F.sum(kept).over(Window.partitionBy("seq_id", "stretch").orderBy("col")) - kept
    return cut.withColumn("own", own).join(before, ["seq_id", "stretch"]).select("seq_id", "col", "ch", (F.col("own") + F.col("before")).cast("int").alias("nb"))


def rows_of(cells: DataFrame) -> DataFrame:
    """seq_id, seq: the aligned rows as strings."""
    return cells.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "ch"))), lambda x: x["ch"]), "").alias("seq"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Cells of aligned rows (seq_id, seq)."""
    return rows.select("seq_id", F.posexplode(F.split("seq", "")).alias("col", "ch"))


def degap(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def gap_insensitive_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is before, like or after b when gaps don't count."""
    x, y = degap(a), degap(b)
    return F.when(x < y, -1).when(x == y, 0).otherwise(1)


def gap_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("seq_id").agg(F.count_if(F.col("ch") == "-").alias("gaps"), F.count("*").alias("length"))


def gap_select(ranked: DataFrame) -> DataFrame:
    """seq_id, k (from 1), col: column of the k-th non-gap cell."""
    return ranked.where("ch <> '-'").select("seq_id", (F.col("nb") + 1).alias("k"), "col")


def range_overlap(lb1: Column, rb1: Column, lb2: Column, rb2: Column) -> Column:
    """How the half-open range 1 meets range 2: INCLUDES, LEFT, RIGHT or DISJOINT."""
    return F.when((rb1 <= lb2) | (rb2 <= lb1), "DISJOINT").when((lb1 <= lb2) & (rb2 <= rb1), "INCLUDES").when(lb1 <= lb2, "LEFT").otherwise("RIGHT")
