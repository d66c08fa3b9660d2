"""Sets of row ids as bitmaps: words of 64 ids, ``WORDS`` words to a bucket, so that a set of any size is a few bounded rows.

A table of sets has key columns, ``bucket`` (id // (64 * WORDS)) and ``bits`` (words from the
bucket's first id on; words that are left out at the end are 0).  Empty buckets have no row.
Ids aren't negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a bucket.
WORDS = 512


def _dense(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, bits of words (keys, bucket, w, b)."""
    listed = df.groupBy(*keys, "bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("top"))
    words = F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("bigint")))
    return listed.select(*keys, "bucket", words.alias("bits"))


def row_sets(pairs: DataFrame, keys: list[str], id_col: str = "seq_id") -> DataFrame:
    """Sets of the ids (keys, id); a repeated pair counts once. Words are put together before they meet."""
    at = F.col(id_col).cast("bigint")
    word = pairs.select(*keys, F.floor(at / (64 * WORDS)).cast("int").alias("bucket"), (F.floor(at / 64) % WORDS).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("b"))
    return _dense(word.groupBy(*keys, "bucket", "w").agg(F.bit_or("b").alias("b")), keys)


def both(a: Column, b: Column) -> Column:
    """Bits that both have."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0).cast("bigint")))


def any_bit(bits: Column) -> Column:
    return F.exists(bits, lambda x: x != 0)


def size_of(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x))


def united(sets: DataFrame, keys: list[str]) -> DataFrame:
    """One set for each different ``keys``: ids that any of its sets has."""
    words = sets.select(*keys, "bucket", F.posexplode("bits").alias("w", "b")).where("b <> 0")
    return _dense(words.groupBy(*keys, "bucket", "w").agg(F.bit_or("b").alias("b")), keys)


def common(sets: DataFrame, keys: list[str], of: int | Column) -> DataFrame:
    """One set for each different ``keys``: ids that all of its ``of`` sets have."""
    words = sets.select(*keys, "bucket", F.posexplode("bits").alias("w", "b"))
    met = words.groupBy(*keys, "bucket", "w").agg(F.bit_and("b").alias("b"), F.count("*").alias("n")).where((F.col("n") == of) & (F.col("b") != 0))
    return _dense(met, keys)


def members(sets: DataFrame, keys: list[str], id_col: str = "seq_id") -> DataFrame:
    """keys, id: a row for each id of each set."""
    words = sets.select(*keys, "bucket", F.posexplode("bits").alias("w", "b")).where("b <> 0")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("b", k) == 1))
    spread = words.select(*keys, "bucket", "w", bit.alias("__bit"))
    return spread.select(*keys, ((F.col("bucket").cast("bigint") * WORDS + F.col("w")) * 64 + F.col("__bit")).cast("int").alias(id_col))


def listed(bits: Column, bucket: Column) -> Column:
    """The ids of one bucket, in order, as an array."""
    each = F.transform(bits, lambda x, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(x, k) == 1), lambda k: (bucket * WORDS + w) * 64 + k))
    return F.flatten(each)
