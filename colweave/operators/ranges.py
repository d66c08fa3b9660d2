"""Ranges of a stored suffix order, narrowed a symbol at a time without a look at the texts.

Of an order only the symbols before its suffixes are kept, in blocks of ``width`` ranks, each
with the counts of every symbol before the block.  How often a symbol stands before a rank
takes one block, so a batch of words takes one join with the blocks at each end of their
ranges for each symbol.  A range for a word in the order and the range of its reverse in the
order of reversed texts are kept in step: what one side gains at its start is the number of
smaller symbols that stand before (or after) the word, which the other side's block tells.

Texts' starts count as the symbol ``START``, smaller than all others.  Words that occur nowhere
drop out as soon as their range is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.functions.scratch import settle

#: Ranks of a block; ranks that one task cuts into blocks.
WIDTH, PART = 512, 1 << 17
#: Stands for the start of a text among symbols.
START = "\x01"


@dataclass
class RankTables:
    """``blocks``: blk, text (symbols), counts (of each symbol before the block); ``symbols``: ch, below (suffixes that start with a smaller one), ends (texts that end with it), n."""

    blocks: DataFrame
    symbols: DataFrame
    width: int = WIDTH

    def save(self, folder: str) -> None:
        """Blocks by ranges of their number."""
        self.blocks.repartitionByRange("blk").sortWithinPartitions("blk").withColumn("width", F.lit(self.width)).write.mode("overwrite").parquet(f"{folder}/blocks")
        self.symbols.coalesce(1).write.mode("overwrite").parquet(f"{folder}/symbols")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> RankTables:
        blocks = spark.read.parquet(f"{folder}/blocks")
        width = blocks.select("width").first()
        return cls(blocks.drop("width"), spark.read.parquet(f"{folder}/symbols"), width[0] if width else WIDTH)


def rank_tables(order: DataFrame, last: DataFrame, width: int = WIDTH, part: int = PART) -> RankTables:
    """Tables of an order (pos, idx, ch); ``last`` has a row ch for each text that isn't empty: its last symbol."""
    if part % width:
        raise ValueError("a part has to hold whole blocks")
    own = order.select("idx", F.when(F.col("pos") == 0, START).otherwise(F.col("ch")).alias("ch"), F.floor(F.col("idx") / part).alias("s"))
    counts = settle(own.groupBy("s", "ch").agg(F.count("*").alias("n")), "part-symbols")
    ends = last.groupBy("ch").agg(F.count("*").alias("ends"))
    # a row for each symbol of the alphabet
    totals = counts.where(F.col("ch") != START).groupBy("ch").agg(F.sum("n").alias("n")).join(ends, "ch", "full").select("ch", F.coalesce("ends", F.lit(0)).alias("ends"), (F.coalesce("n", F.lit(0)) + F.coalesce("ends", F.lit(0))).alias("n"))
    symbols = settle(totals.select("ch", (F.sum("n").over(Window.orderBy("ch")) - F.col("n")).alias("below"), "ends", "n"), "symbols")
    letters = [START, *sorted(r.ch for r in symbols.select("ch").collect())]
    # parts x symbols
    grid = counts.select("s").distinct().select("s", F.explode(F.lit(letters)).alias("ch")).join(counts, ["s", "ch"], "left")
    base = grid.select("s", "ch", (F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("ch").orderBy("s")) - F.coalesce("n", F.lit(0))).alias("before"))
    size = order.agg(F.count("*")).first()[0]

    def cut(_, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        first = left["idx"][0].as_py()
        text = "".join(left["ch"].to_pylist())
        now = dict(zip(right["ch"].to_pylist(), right["before"].to_pylist(), strict=True))
        rows = []
        # a block after the last full one, so that the rank after the last has one
        for a in range(0, len(text) + (first + len(text) == size and size % width == 0), width):
            own = text[a : a + width]
            rows.append(((first + a) // width, own, list(now.items())))
            for c in set(own):
                now[c] += own.count(c)
        kinds = (pa.int64(), pa.string(), pa.map_(pa.string(), pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["blk", "text", "counts"])

    blocks = own.groupBy("s").cogroup(base.groupBy("s")).applyInArrow(cut, "blk bigint, text string, counts map<string,bigint>")
    return RankTables(settle(blocks, "rank-blocks"), symbols, width)


def last_symbols(texts: DataFrame) -> DataFrame:
    """ch: the last symbol of each text (text_id, s) that isn't empty."""
    return texts.where("s <> ''").select(F.expr("substring(s, -1)").alias("ch"))


def _standing(tables: RankTables, states: DataFrame, at: Column, name: str, symbol: str, smaller: bool) -> DataFrame:
    """``states`` with ``name``: how often ``symbol`` stands before the rank ``at``; and with ``smaller``, how often smaller ones do."""
    blocks = tables.blocks.select(F.col("blk").alias("__blk"), F.col("text").alias("__text"), F.col("counts").alias("__counts"))
    met = states.withColumn("__at", at).withColumn("__blk", F.floor(F.col("__at") / tables.width)).join(blocks.hint("merge"), "__blk")
    head = F.substring(F.col("__text"), F.lit(1), F.pmod("__at", F.lit(tables.width)).cast("int"))
    own = F.length(head) - F.length(F.replace(head, F.col(symbol), F.lit("")))
    out = met.withColumn(name, F.coalesce(F.get(F.map_values(F.map_filter("__counts", lambda k, _: k == F.col(symbol))), F.lit(0)), F.lit(0)) + own)
    if smaller:
        before = F.aggregate(F.map_values(F.map_filter("__counts", lambda k, _: k < F.col(symbol))), F.lit(0).cast("bigint"), lambda a, n: a + n)
        out = out.withColumn(f"{name}_less", before + F.size(F.filter(F.split(head, ""), lambda x: (x != "") & (x < F.col(symbol)))))
    return out.drop("__at", "__blk", "__text", "__counts")


def extended(tables: RankTables, states: DataFrame, symbol: str = "c", lb: str = "lb", rb: str = "rb", co: tuple[str, str] | None = None) -> DataFrame:
    """``states`` whose words are made longer by ``symbol`` in front: ranges lb, rb (closed), and those in the other order, ``co``; without those that occur nowhere."""
    known = states.join(tables.symbols.select(F.col("ch").alias(symbol), F.col("below").alias("__below"), F.col("ends").alias("__ends")), symbol)
    met = _standing(tables, known, F.col(lb), "__i", symbol, co is not None)
    met = _standing(tables, met, F.col(rb) + 1, "__j", symbol, co is not None)
    # suffixes of the symbol alone, at the texts' ends, come before its longer ones
    start = F.col("__below") + F.col("__ends")
    new = {lb: start + F.col("__i"), rb: start + F.col("__j") - 1}
    if co is not None:
        first = F.col(co[0]) + F.col("__j_less") - F.col("__i_less")
        new |= {co[0]: first, co[1]: first + F.col("__j") - F.col("__i") - 1}
    return met.where("__i < __j").withColumns(new).select(*states.columns)


def started(tables: RankTables, states: DataFrame, symbol: str = "c", *names: str) -> DataFrame:
    """``states`` with the range of the word that ``symbol`` alone is, under each pair of ``names`` (lb, rb)."""
    own = tables.symbols.select(F.col("ch").alias(symbol), F.col("below").alias("__lb"), (F.col("below") + F.col("n") - 1).alias("__rb"))
    return states.join(own, symbol).withColumns({c: F.col("__rb" if k % 2 else "__lb") for k, c in enumerate(names or ("lb", "rb"))}).drop("__lb", "__rb")


def _letter(at: Column) -> Column:
    return F.substring(F.col("pattern"), at.cast("int"), F.lit(1))


def stored_ranges(patterns: DataFrame, tables: RankTables) -> DataFrame:
    """pattern, lb, rb of each different pattern that occurs, from its end to its start."""
    asked = patterns.select("pattern").where("pattern <> ''").distinct().withColumn("k", F.length("pattern"))
    now = settle(started(tables, asked.withColumn("c", _letter(F.col("k")))).drop("c"), "ranges")
    out = now.where("k = 1").select("pattern", "lb", "rb")
    while not (now := now.where("k > 1")).isEmpty():
        going = now.withColumn("k", F.col("k") - 1)
        now = settle(extended(tables, going.withColumn("c", _letter(F.col("k")))).drop("c"), "ranges")
        out = out.unionByName(now.where("k = 1").select("pattern", "lb", "rb"))
    return out


def stored_counts(patterns: DataFrame, tables: RankTables) -> DataFrame:
    """pattern, n of each different pattern; 0 for those that don't occur."""
    found = stored_ranges(patterns, tables).select("pattern", (F.col("rb") - F.col("lb") + 1).alias("n"))
    return patterns.select("pattern").distinct().join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def alternating_ranges(patterns: DataFrame, ahead: RankTables, back: RankTables) -> DataFrame:
    """pattern, lb, rb, co_lb, co_rb of each different pattern that occurs: from its middle, one symbol to the left and one to the right in turn.

    ``ahead`` are tables of the order, ``back`` of that of the reversed texts; lb, rb are ranks
    of suffixes that start with the pattern, co_lb, co_rb of reversed prefixes that start with
    it reversed.
    """
    size = F.length("pattern")
    asked = patterns.select("pattern").where("pattern <> ''").distinct().withColumn("a", F.floor((size + 1) / 2)).withColumn("z", F.col("a"))
    now = settle(started(ahead, asked.withColumn("c", _letter(F.col("a"))), "c", "lb", "rb", "co_lb", "co_rb").drop("c"), "states")
    whole, turn = (F.col("a") == 1) & (F.col("z") == size), 0
    out = now.where(whole).select("pattern", "lb", "rb", "co_lb", "co_rb")
    while not (now := now.where(~whole)).isEmpty():
        left = (F.col("a") > 1) & (F.lit(turn % 2 == 0) | (F.col("z") == size))
        one = now.where(left).withColumn("a", F.col("a") - 1)
        other = now.where(~left).withColumn("z", F.col("z") + 1)
        one = extended(ahead, one.withColumn("c", _letter(F.col("a"))), co=("co_lb", "co_rb"))
        other = extended(back, other.withColumn("c", _letter(F.col("z"))), lb="co_lb", rb="co_rb", co=("lb", "rb"))
        now, turn = settle(one.unionByName(other).drop("c"), "states"), turn + 1
        out = out.unionByName(now.where(whole).select("pattern", "lb", "rb", "co_lb", "co_rb"))
    return out
