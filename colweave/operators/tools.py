"""Summaries, comparisons and range utilities over segmentations, graphs and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_histogram(raw: DataFrame) -> DataFrame:
    """len (null: invalid columns), n."""
    return raw.groupBy((F.col("rb") - F.col("lb") + 1).alias("len")).agg(F.count("*").alias("n"))


def right_bound_histogram(raw: DataFrame) -> DataFrame:
    return raw.where("rb IS NOT NULL").groupBy("rb").agg(F.count("*").alias("n"))


def length_summary(histogram: DataFrame) -> DataFrame:
    """min_len, max_len, mean_len, median_len of a histogram; the median is the first length whose running count reaches half of the total, rounded down."""
    h = histogram.where("len IS NOT NULL")
    running = h.withColumn("cum", F.sum("n").over(Window.orderBy("len"))).crossJoin(h.agg(F.sum("n").alias("total")))
    return running.agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"), F.min(F.when(F.col("cum") >= F.floor(F.col("total") / 2), F.col("len"))).alias("median_len"))


def padded_ranges(ranges: DataFrame, padding: int) -> DataFrame:
    """Half-open ranges shrunk by ``padding`` at both ends; those under twice that go."""
    return ranges.where(F.col("rb") - F.col("lb") >= 2 * padding).select((F.col("lb") + padding).alias("lb"), (F.col("rb") - padding).alias("rb"))


#: Width of the stretches that unkeyed ranges are merged in.
STRETCH = 1 << 20


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping or touching ranges as one; empty ones go. By ``key`` if there is one.

    Ranges are dealt by stretches of their start; how far the ranges of earlier stretches
    reach is carried from one stretch to the next.
    """
    key = ["key"] if "key" in ranges.columns else []
    cut = ranges.where("lb < rb").withColumn("__s", F.floor(F.col("lb") / STRETCH))
    stretches = cut.groupBy(*key, "__s").agg(F.max("rb").alias("__far"))
    earlier = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    reach = stretches.select(*key, "__s", F.max("__far").over(earlier).alias("__before"))
    w = Window.partitionBy(*key, "__s").orderBy("lb", "rb")
    far = F.greatest(F.max("rb").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    marked = cut.join(reach, [*key, "__s"]).withColumn("__new", F.when(F.col("lb") <= far, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    news = marked.groupBy(*key, "__s").agg(F.sum("__new").alias("__n"))
    base = news.select(*key, "__s", (F.sum("__n").over(Window.partitionBy(*key).orderBy("__s")) - F.col("__n")).alias("__b"))
    return marked.join(base, [*key, "__s"]).withColumn("__g", F.col("__g") + F.col("__b")).groupBy(*key, "__g").agg(F.min("lb").alias("lb"), F.max("rb").alias("rb")).drop("__g")


def remove_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, kept: each text (key, s) without its half-open ranges (key, lb, rb)."""
    cuts = merged_ranges(ranges).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lb", "rb"))).alias("cuts"))
    size = F.length("s")
    cut = F.col("cuts")
    inner = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["rb"]).alias("a"), F.when(i == F.size(cut), size).otherwise(F.least(F.get(cut, i)["lb"], size)).alias("b")))
    kept = F.array_join(F.transform(inner, lambda x: F.substring(F.col("s"), (x["a"] + 1).cast("int"), F.greatest(x["b"] - x["a"], F.lit(0)).cast("int"))), "")
    return texts.join(cuts, "key", "left").select("key", F.when(cut.isNull(), F.col("s")).otherwise(kept).alias("kept"))


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status SAME, DIFFERENT, LEFT or RIGHT: a full outer join, nulls like any value."""
    values = [c for c in left.columns if c not in keys]
    a, b = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1)).withColumnsRenamed({c: f"__r_{c}" for c in values})
    both = a.join(b, keys, "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return both.select(*keys, F.when(F.col("__r").isNull(), "LEFT").when(F.col("__l").isNull(), "RIGHT").when(same, "SAME").otherwise("DIFFERENT").alias("status"))


def elias_split(values: DataFrame, column: str, low_bits: int, order: str = "pos") -> DataFrame:
    """Values that don't fall along ``order`` (from 0, without holes): high part, low bits, and mark, where the unary code of the high parts has their 1."""
    high = F.shiftright(column, low_bits)
    return values.withColumn("high", high).withColumn("low", F.col(column).bitwiseAND((1 << low_bits) - 1)).withColumn("mark", (high + F.col(order)).cast("bigint"))


def elias_join(split: DataFrame, low_bits: int, order: str = "pos") -> DataFrame:
    """The values again, as column ``value``, from their marks and low bits."""
    return split.withColumn("value", F.shiftleft((F.col("mark") - F.col(order)).cast("bigint"), low_bits).bitwiseOR(F.col("low")))


def bits_needed(value: F.Column) -> F.Column:
    """Bits of a value that isn't negative, 1 at least."""
    return F.when(value <= 0, 1).otherwise(F.length(F.bin(value))).cast("int")


def round_up(value: F.Column, multiple: int) -> F.Column:
    """The next multiple at or over a value."""
    return (F.ceil(value / multiple) * multiple).cast("bigint")


def repeated_ids(rows: DataFrame, column: str = "seq_id") -> DataFrame:
    """Ids that more than one row has, with their number n."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def running_coverage(cells: DataFrame, span: int = 2) -> DataFrame:
    """seq_id, col, covered (non-gap cells up to the column), and the same one to ``span`` columns before (lag1, ...; 0 before the start)."""
    upto = cells.select("seq_id", "col", (F.col("nb") + F.when(F.col("ch") != "-", 1).otherwise(0)).alias("covered"))
    out = upto
    for k in range(1, span + 1):
        out = out.join(upto.select("seq_id", (F.col("col") + k).alias("col"), F.col("covered").alias(f"lag{k}")), ["seq_id", "col"], "left").withColumn(f"lag{k}", F.coalesce(f"lag{k}", F.lit(0)))
    return out
