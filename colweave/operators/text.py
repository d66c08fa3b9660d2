"""Text operators over a table of texts (text_id, s): order of suffixes, ranges and counts of patterns, transforms, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.operators import suffixes as S

#: Characters by which longer words are looked up before they are compared; words that are broadcast to the places in texts.
SEED, FEW = 12, 20_000
#: Values that a task sorts.
MOST = 500_000


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """text_id, pos (from 0), suf (its first ``length`` characters, ``suffixes.BLOCK`` at most), prev_char ('$' before the start)."""
    blocks = S.text_blocks(texts, S.BLOCK)
    spread = blocks.select("text_id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    here = spread.select("text_id", (F.col("block") * S.BLOCK + F.col("i")).alias("pos"), F.substring(F.col("text"), F.col("i") + 1, F.lit(length)).alias("suf"))
    before = here.select("text_id", (F.col("pos") + 1).alias("pos"), F.substring("suf", 1, 1).alias("c"))
    return here.join(before.hint("merge"), ["text_id", "pos"], "left").select("text_id", F.col("pos").cast("int").alias("pos"), "suf", F.coalesce("c", F.lit("$")).alias("prev_char"))


def suffix_array(texts: DataFrame) -> DataFrame:
    """text_id, pos, idx (rank from 0), lcp (with the one before), ch (the character before it): whole suffixes, equal ones by text_id and pos."""
    return S.suffix_order(texts)


def bwt(ordered: DataFrame) -> DataFrame:
    return ordered.select("idx", "ch")


def _spots(blocks: DataFrame, longest: int) -> DataFrame:
    """win: the next ``longest`` characters from every position."""
    spread = blocks.select("text_id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    return spread.select("text_id", "block", "i", F.substring(F.col("text"), F.col("i") + 1, F.lit(longest)).alias("win"))


def _seeded(words: DataFrame) -> DataFrame:
    """word, size (of its seed), seed."""
    size = F.least(F.length("word"), F.lit(SEED))
    return words.where("word <> ''").select("word", size.alias("size"), F.substring(F.col("word"), F.lit(1), size).alias("seed"))


def beside(seeded: DataFrame, n: int) -> DataFrame:
    """``n`` words for a join with places in texts, which Spark takes for as few as the texts' files are small: it is they that are broadcast, or nothing is."""
    return F.broadcast(seeded) if n <= FEW else seeded.hint("merge")


def word_counts(blocks_of: Callable[[int], DataFrame], words: DataFrame) -> DataFrame:
    """word, n: occurrences in all texts of each different word that occurs, overlapping ones included.

    ``blocks_of`` gives the texts in blocks of a size.  Linear in the texts: from every position one substring for each length of a seed (``SEED``
    characters at most), counted before they meet the words.  Where the seed of longer words
    occurs, one substring for each different length of these is counted, however many words
    and places share the seed.
    """
    seeded = _seeded(words.select("word").distinct())
    facts = seeded.agg(F.count("*").alias("n"), F.max(F.length("word")).alias("longest"), F.collect_set("size").alias("sizes")).first()
    if not facts.longest:
        return words.select("word", F.lit(0).cast("bigint").alias("n")).limit(0)
    blocks = blocks_of(max(S.BLOCK, facts.longest))
    spots = _spots(blocks, facts.longest)
    keyed = spots.select("win", F.explode(F.lit(sorted(facts.sizes))).alias("size")).where(F.length("win") >= F.col("size")).select("size", F.substring(F.col("win"), F.lit(1), F.col("size")).alias("seed"))
    short = keyed.groupBy("size", "seed").agg(F.count("*").alias("n")).join(beside(seeded.where(F.length("word") == F.col("size")), facts.n), ["size", "seed"]).select("word", "n")
    if facts.longest <= SEED:
        return short
    longer = seeded.where(F.length("word") > SEED)
    sized = longer.groupBy("seed").agg(F.collect_set(F.length("word")).alias("sizes"))
    met = spots.where(F.length("win") > SEED).select("win", F.substring("win", 1, SEED).alias("seed")).join(beside(sized, facts.n), "seed")
    cut = met.select("win", F.explode(F.filter("sizes", lambda n: n <= F.length("win"))).alias("n")).select(F.substring(F.col("win"), F.lit(1), F.col("n")).alias("word"))
    return short.unionByName(cut.groupBy("word").agg(F.count("*").alias("n")).join(beside(longer.select("word"), facts.n), "word").select("word", "n"))


def pattern_counts(texts: DataFrame | Callable[[int], DataFrame], patterns: DataFrame) -> DataFrame:
    """pattern, n: occurrences of each different pattern in texts, or in what gives their blocks; 0 for those that don't occur."""
    each = patterns.select("pattern").distinct()
    found = word_counts(texts if callable(texts) else lambda size: S.text_blocks(texts, size), each.select(F.col("pattern").alias("word"))).withColumnRenamed("word", "pattern")
    return each.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def pattern_ranges(texts: DataFrame, patterns: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """pattern, lb, rb (closed): ranks of the suffixes that start with each pattern that occurs."""
    order = suffix_array(texts) if order is None else order
    seeded = _seeded(patterns.select(F.col("pattern").alias("word")).distinct())
    facts = seeded.agg(F.count("*").alias("n"), F.max(F.length("word")).alias("longest"), F.collect_set("size").alias("sizes")).first()
    size = max(S.BLOCK, facts.longest or 1)
    spots = _spots(S.text_blocks(texts, size), facts.longest or 1).select("text_id", (F.col("block") * size + F.col("i")).alias("pos"), "win", F.explode(F.lit(sorted(facts.sizes or [1]))).alias("size"))
    met = spots.select("*", F.substring(F.col("win"), F.lit(1), F.col("size")).alias("seed")).join(beside(seeded, facts.n), ["size", "seed"]).where(F.col("win").startswith(F.col("word")))
    return met.select("text_id", F.col("pos").cast("int").alias("pos"), "word").join(order.select("text_id", "pos", "idx").hint("merge"), ["text_id", "pos"]).groupBy(F.col("word").alias("pattern")).agg(F.min("idx").alias("lb"), F.max("idx").alias("rb"))


def bidirectional_ranges(texts: DataFrame, patterns: DataFrame, order: DataFrame | None = None, reverse_order: DataFrame | None = None) -> DataFrame:
    """pattern, lb, rb, co_lb, co_rb: ranks of suffixes that start with the pattern, and of reversed prefixes that start with it reversed."""
    back = texts.select("text_id", F.reverse("s").alias("s"))
    ahead = pattern_ranges(texts, patterns, order)
    behind = pattern_ranges(back, patterns.select(F.reverse("pattern").alias("pattern")), reverse_order).select(F.reverse("pattern").alias("pattern"), F.col("lb").alias("co_lb"), F.col("rb").alias("co_rb"))
    return ahead.join(behind, "pattern")


def left_extensions(texts: DataFrame, length: int) -> DataFrame:
    """kmer, symbols: sorted distinct characters before each substring of ``length`` characters."""
    return suffixes(texts, length).where(F.length("suf") == length).groupBy(F.col("suf").alias("kmer")).agg(F.array_join(F.array_sort(F.collect_set("prev_char")), "").alias("symbols"))


def run_lengths(values: DataFrame, part: str, order: str, value: str, stretch: int = 4096) -> DataFrame:
    """part, run (from 0), value, n: maximal runs of equal values along the integers ``order``, from 0 without holes.

    A run starts where the value differs from the one before; runs are numbered in stretches.
    Values are dealt before anything sorts them, so that no task sorts more than its share of them.
    """
    cut = values.select(part, order, value, F.floor(F.col(order) / stretch).alias("__s"))
    # a number of parts is kept as it is, where Spark would put parts of one stage together by their packed size
    width = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // MOST))
    cut = cut.repartition(width, part, "__s")
    inner = Window.partitionBy(part, "__s").orderBy(order)
    # the last value of a stretch stands before the first one of the next
    ends = cut.groupBy(part, "__s").agg(F.max_by(F.struct(value), order).alias("__e")).select(part, (F.col("__s") + 1).alias("__s"), "__e")
    before = F.when(F.row_number().over(inner) == 1, F.col("__e")).otherwise(F.lag(F.struct(value)).over(inner))
    marked = cut.join(ends, [part, "__s"], "left").withColumn("__new", F.when(before.isNotNull() & before[value].eqNullSafe(F.col(value)), 0).otherwise(1))
    sums = marked.groupBy(part, "__s").agg(F.sum("__new").alias("__n"))
    base = sums.select(part, "__s", (F.sum("__n").over(Window.partitionBy(part).orderBy("__s")) - F.col("__n")).alias("__b"))
    run = (F.sum("__new").over(inner) + F.col("__b") - 1).cast("bigint")
    numbered = marked.join(base, [part, "__s"]).withColumn("run", run)
    # by the value too, which a run has one of: such rows are counted in a hash table
    return numbered.groupBy(part, "run", value).agg(F.count("*").alias("n"))
