"""The order of a collection that grows: the stored order of its texts and that of added ones, merged.

Stored suffixes aren't sorted again.  Every ``width``-th of them is a head; added suffixes are
sorted among the heads, which tells the stretch of stored ranks that each falls into.  The
stretches that any falls into are then opened: their suffixes are sorted with the added ones
and the heads.  All other stretches move as a whole, by the number of added suffixes before
their head.

What a suffix shares with the one before it changes only where that one is new, and both are
among the sorted ones then: an added suffix's neighbour before it is another one, or a stored
one of its own opened stretch; a stored suffix that follows an added one is in an opened
stretch, or is the head after it.

With ``m`` added suffixes and ``n`` stored ones, m + n / width + m * width at most are sorted;
``width`` is the root of n / m unless given.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.order import running_max, running_sum
from colweave.functions.scratch import settle
from colweave.operators.suffixes import PIECE, order_among, suffix_order, text_blocks


def extended_order(order: DataFrame, texts: DataFrame, added: DataFrame, *, width: int | None = None, length: int = PIECE) -> DataFrame:
    """text_id, pos, idx, lcp, ch: the order of ``texts`` and ``added`` (text_id, s), from the ``order`` of ``texts``.

    Equal to ``suffix_order`` of both.  Empty and null texts have no suffixes; an id that both
    tables have raises; ``order`` is a written table that is read several times.
    """
    if not texts.select("text_id").join(added.select("text_id"), "text_id", "left_semi").isEmpty():
        raise ValueError("an added text has the id of another one")
    columns = ["text_id", "pos", "idx", "lcp", "ch"]
    order = order.select(*columns)
    new = settle(suffix_order(added, length), "added-order").select(*columns)
    old_size, new_size = order.count(), new.count()
    if not old_size or not new_size:
        return order if old_size else new
    width = width or max(1, isqrt(old_size // new_size))
    both = texts.select("text_id", "s").unionByName(added.select("text_id", "s"))
    sizes = both.select("text_id", F.length("s").cast("bigint").alias("all"))
    is_head, stretch = F.col("idx") % width == 0, F.floor(F.col("idx") / width)

    def sorted_with(stored: DataFrame) -> DataFrame:
        """Added and these stored suffixes in order (at, shared): old (rank so far), was (shared so far), added ones before, under (the last old before)."""
        mine = new.select("text_id", "pos", "ch", F.lit(None).cast("bigint").alias("old"), F.lit(None).cast("int").alias("was"))
        chosen = settle(mine.unionByName(stored.select("text_id", "pos", "ch", F.col("idx").alias("old"), F.col("lcp").alias("was"))), "chosen")
        suffixes = chosen.join(sizes, "text_id").select("text_id", F.col("pos").cast("bigint").alias("pos"), (F.col("all") - F.col("pos")).alias("size"))
        placed, _ = order_among(suffixes, lambda n: text_blocks(both, n), length)
        met = placed.select("text_id", "pos", F.col("idx").alias("at"), F.col("lcp").alias("shared")).join(chosen, ["text_id", "pos"])
        met = settle(met.withColumn("new", F.col("old").isNull().cast("bigint")), "met")
        return settle(running_max(running_sum(met, "at", {"before": "new"}), "at", {"under": "old"}), "placed-among")

    heads = order.where(is_head)
    met = sorted_with(heads)
    opened = settle(met.where("old IS NULL AND under IS NOT NULL").select(F.floor(F.col("under") / width).alias("stretch")).distinct(), "opened")
    others = order.where(~is_head).withColumn("stretch", stretch)
    if width > 1:
        met = sorted_with(heads.unionByName(others.join(opened, "stretch", "left_semi").select(*columns)))
    moved = F.when(F.col("old").isNull(), F.col("before") + F.coalesce(F.col("under") + 1, F.lit(0))).otherwise(F.col("old") + F.col("before"))
    # the one before is among the sorted ones, or is the one that it was
    known = F.col("old").isNull() | (F.col("old") == 0) | (F.col("under") == F.col("old") - 1)
    among = met.select("text_id", F.col("pos").cast("int").alias("pos"), moved.alias("idx"), F.when(known, F.col("shared")).otherwise(F.col("was")).alias("lcp"), "ch")
    shift = met.where(F.col("old") % width == 0).select(F.floor(F.col("old") / width).alias("stretch"), "before")
    closed = others.join(opened, "stretch", "left_anti").join(shift, "stretch")
    return among.unionByName(closed.select("text_id", "pos", (F.col("idx") + F.col("before")).alias("idx"), "lcp", "ch"))
