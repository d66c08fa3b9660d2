"""Global order without a window over a table: rows are dealt by ranges of their keys and numbered part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.scratch import settle

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` with a running number from 0 along ``keys`` (columns that tell all rows apart)."""
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # an id's upper bits are the part's number, the lower ones count within it
    dealt = settle(df.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(_LOW))
    # a row for each part
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    base = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__base"))
    return dealt.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__id", "__part", "__at", "__base")


def running_sum(df: DataFrame, order: str, values: dict[str, str], stretch: int = 4096) -> DataFrame:
    """``df`` with sums of earlier rows along the integer column ``order``, by name of value: totals of stretches first, then within one."""
    cut = df.withColumn("__s", F.floor(F.col(order) / stretch))
    totals = cut.groupBy("__s").agg(*(F.sum(v).alias(f"__t_{k}") for k, v in values.items()))
    over = Window.orderBy("__s")
    base = totals.select("__s", *((F.sum(f"__t_{k}").over(over) - F.col(f"__t_{k}")).alias(f"__b_{k}") for k in values))
    own = Window.partitionBy("__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.select(*df.columns, "__s", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"__o_{k}") for k, v in values.items()))
    return inner.join(base, "__s").select(*df.columns, *((F.col(f"__o_{k}") + F.col(f"__b_{k}")).cast("bigint").alias(k) for k in values))


def running_max(df: DataFrame, order: str, values: dict[str, str], stretch: int = 4096) -> DataFrame:
    """``df`` with the largest value of earlier rows along the integer column ``order`` (null: there is none), by name of value."""
    cut = df.withColumn("__s", F.floor(F.col(order) / stretch))
    # a row for each stretch
    tops = cut.groupBy("__s").agg(*(F.max(v).alias(f"__t_{k}") for k, v in values.items()))
    over = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select("__s", *(F.max(f"__t_{k}").over(over).alias(f"__b_{k}") for k in values))
    own = Window.partitionBy("__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.select(*df.columns, "__s", *(F.max(v).over(own).alias(f"__o_{k}") for k, v in values.items()))
    # greatest passes over nulls
    return inner.join(base, "__s").select(*df.columns, *(F.greatest(f"__o_{k}", f"__b_{k}").alias(k) for k in values))
