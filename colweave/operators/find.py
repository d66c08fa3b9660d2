"""Pattern location in a block graph.

A pattern *expands* if some suffix of it occurs in the indexable text and every occurrence
there starts with one and the same shortest-prefix label.  The answer of one that expands is
the set of rows whose ungapped text holds the pattern, with its aligned position; of one that
doesn't, the number of its occurrences in the indexable text.

Occurrences are walked through the graph: a pattern starts within a node's label, and goes on
along edges, one node a step, with the set of rows that pass through all nodes so far.  Sets
are bitmaps in buckets of bounded size, so no row carries the ids of all inputs.

Where a pattern can start is found through *seeds*: the rests of all labels, from every place
on, under their first characters, for several lengths of these.  A stored table of seeds is
dealt into folders by a hash of the seed, and a batch of patterns reads its own folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions import rowsets as R
from colweave.functions.scratch import settle
from colweave.operators import suffixes as S
from colweave.operators import text as T

#: Lengths of seeds; folders of a stored table of them.
SEEDS, FOLDERS = (1, 2, 3, 4, 6, 8, 12, 16), 256


def expanding(patterns: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """pattern, did_expand.

    For a suffix q that occurs: a shortest-prefix label is a prefix of it, or q is a prefix of
    one that occurs as often.  Such a label's first ``text.SEED`` characters occur as often as a
    q that isn't longer, so few labels have to be counted as a whole.
    """
    tails = patterns.select("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.length("pattern")), lambda i: F.substring(F.col("pattern"), i, F.length("pattern")))).alias("q")).where("q <> ''")
    labels = found.where("is_shortest_prefix AND label <> ''").select("label").distinct()
    texts = lines.select(F.col("off").alias("text_id"), F.col("text").alias("s"))
    blocks = lambda size: S.text_blocks(texts, size)
    head = F.substring("label", 1, T.SEED)
    words = tails.select(F.col("q").alias("word")).unionByName(labels.select(head.alias("word"))).distinct()
    counts = settle(T.word_counts(blocks, words), "word-counts")
    q = settle(tails.select("q").distinct().join(counts.withColumnsRenamed({"word": "q", "n": "n_q"}), "q"), "tails")
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    longest = q.agg(F.max(F.length("q"))).first()[0] or 0
    inside = q.select("q", prefixes("q").alias("label")).join(labels, "label", "left_semi").select("q")
    good = inside
    if longest:
        headed = labels.withColumn("head", head).join(counts.withColumnsRenamed({"word": "head", "n": "n_v"}).hint("merge"), "head")
        cut = headed.select("label", "n_v", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("label"), F.lit(longest))), lambda n: F.substring(F.col("label"), F.lit(1), n))).alias("q"))
        met = settle(cut.join(T.beside(q, q.count()), "q").where((F.col("n_q") == F.col("n_v")) | (F.length("q") > T.SEED)), "heads")
        long = met.where(F.length("label") > T.SEED).select("label", "q", "n_q")
        whole = T.word_counts(blocks, long.select(F.col("label").alias("word"))).withColumnRenamed("word", "label")
        around = met.where(F.length("label") <= T.SEED).select("q").unionByName(long.join(whole.hint("merge"), "label").where("n_q = n").select("q"))
        good = good.unionByName(around)
    good = good.distinct()
    return patterns.join(tails.join(good, "q", "left_semi").select("pattern").distinct().withColumn("e", F.lit(True)), "pattern", "left").select(*patterns.columns, F.coalesce("e", F.lit(False)).alias("did_expand"))


def _folder(size: str, seed: str) -> F.Column:
    return F.pmod(F.xxhash64(size, seed), F.lit(FOLDERS)).cast("int")


def _under_seeds(df: DataFrame, text: str) -> DataFrame:
    """A row for each length of seeds that ``text`` has: size, seed."""
    sizes = F.filter(F.lit(list(SEEDS)), lambda n: n <= F.length(text))
    return df.withColumn("size", F.explode(sizes)).withColumn("seed", F.substring(F.col(text), F.lit(1), F.col("size")))


def seeds(found: DataFrame) -> DataFrame:
    """folder, size, seed, node_idx, block_idx, offset, rest: the label of every node from every place on, under each of its seeds."""
    rests = found.where("label <> ''").select("node_idx", "block_idx", "label", F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("offset"))
    keyed = _under_seeds(rests.select("node_idx", "block_idx", "offset", F.expr("substring(label, offset + 1)").alias("rest")), "rest")
    return keyed.select(_folder("size", "seed").alias("folder"), "size", "seed", "node_idx", "block_idx", "offset", "rest")


def node_sets(paths: DataFrame) -> DataFrame:
    """node_idx, bucket, bits: the rows through each node."""
    return R.row_sets(paths, ["node_idx"])


def starts(patterns: DataFrame, stored: DataFrame) -> DataFrame:
    """pattern, node_idx, block_idx, offset, rest: places where a label goes on as the pattern does, as far as both reach."""
    asked = _under_seeds(patterns.select("pattern").where("pattern <> ''").distinct(), "pattern").withColumn("folder", _folder("size", "seed"))
    # folders only: at most FOLDERS numbers
    folders = [r.folder for r in asked.select("folder").distinct().collect()]
    met = stored.where(F.col("folder").isin(folders)).join(asked, ["folder", "size", "seed"])
    # each pair meets under every seed that both have: the longest one counts
    longest = F.array_max(F.filter(F.lit(list(SEEDS)), lambda n: (n <= F.length("rest")) & (n <= F.length("pattern"))))
    met = met.where((F.col("size") == longest) & (F.col("rest").startswith(F.col("pattern")) | F.col("pattern").startswith(F.col("rest"))))
    return met.select("pattern", "node_idx", "block_idx", "offset", "rest")


def locate(patterns: DataFrame, found: DataFrame, edges: DataFrame, paths: DataFrame, stored: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """pattern, node_idx, block_idx, offset (in the node's label), bucket, bits (set of rows): every occurrence that some row passes through.

    As many rounds as the longest way of a pattern has nodes.  ``stored`` and ``sets`` are
    tables of ``seeds`` and ``node_sets``, made here if there are none.
    """
    stored = seeds(found) if stored is None else stored
    sets = settle(node_sets(paths), "node-sets") if sets is None else sets
    first = starts(patterns, stored).join(sets, "node_idx")
    state = ["pattern", "node_idx", "block_idx", "offset", "bucket", "bits", "at", "done"]
    now = settle(first.select("pattern", "node_idx", "block_idx", "offset", "bucket", "bits", F.col("node_idx").alias("at"), F.length("rest").alias("done")), "starts")
    out = now.where("done >= length(pattern)")
    step = edges.select(F.col("lhs_idx").alias("at"), F.col("rhs_idx").alias("to"), F.col("rhs_label").alias("label"))
    more = sets.select(F.col("node_idx").alias("to"), "bucket", F.col("bits").alias("more"))
    while not (now := now.where("done < length(pattern)")).isEmpty():
        left = F.expr("substring(pattern, done + 1)")
        ahead = now.join(step, "at").where(F.col("label").startswith(left) | left.startswith(F.col("label")))
        ahead = ahead.join(more, ["to", "bucket"]).withColumn("bits", R.both(F.col("bits"), F.col("more"))).where(R.any_bit(F.col("bits")))
        now = settle(ahead.select("pattern", "node_idx", "block_idx", "offset", "bucket", "bits", F.col("to").alias("at"), (F.col("done") + F.length("label")).alias("done")).select(*state), "walks")
        out = out.unionByName(now.where("done >= length(pattern)"))
    # ways that part and meet again end at different nodes: their rows are those of one occurrence
    return R.united(out, ["pattern", "node_idx", "block_idx", "offset"])


def find(patterns: DataFrame, ranked: DataFrame, seg: DataFrame, lines: DataFrame, found: DataFrame, edges: DataFrame, paths: DataFrame, stored: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """pattern, did_expand, match_count, block_aln_pos, match_offset, matches (row ids joined by ',').

    block_aln_pos is the start of the block of the first occurrence by aligned column;
    match_offset counts aligned columns from there.  Patterns that don't expand have the number
    of occurrences in the indexable text, position and offset 0 and no rows.
    """
    marked = settle(expanding(patterns.select("pattern").distinct(), lines, found), "expanding")
    spots = settle(locate(marked.where("did_expand"), found, edges, paths, stored, sets), "occurrences")
    whole = R.united(spots, ["pattern"])
    named = whole.select("pattern", "bucket", R.size_of(F.col("bits")).alias("n"), F.array_join(F.transform(R.listed(F.col("bits"), F.col("bucket")), lambda x: x.cast("string")), ",").alias("ids"))
    rows = named.groupBy("pattern").agg(F.sum("n").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ids"))), lambda x: x["ids"]), ",").alias("matches"))
    # columns are asked of the gap index for the first block's occurrences only
    least = spots.groupBy("pattern").agg(F.min("block_idx").alias("block_idx"))
    first = R.members(spots.join(least, ["pattern", "block_idx"]), ["pattern", "block_idx", "offset"])
    base = ranked.join(seg.select("block_idx", F.col("lb").cast("int").alias("col")), "col").select("block_idx", "seq_id", F.col("nb").alias("before"))
    place = ranked.where("ch <> '-'").select("seq_id", "nb", "col")
    placed = first.join(base, ["block_idx", "seq_id"]).withColumn("nb", F.col("before") + F.col("offset")).join(place, ["seq_id", "nb"])
    start = placed.groupBy("pattern", "block_idx").agg(F.min("col").cast("bigint").alias("col")).join(seg.select("block_idx", "lb"), "block_idx")
    answer = rows.join(start, "pattern").select("pattern", "rows", "matches", "lb", (F.col("col") - F.col("lb")).alias("off"))
    raw = T.pattern_counts(lines.select(F.col("off").alias("text_id"), F.col("text").alias("s")), marked.where("NOT did_expand").select("pattern"))
    both = marked.join(answer, "pattern", "left").join(raw, "pattern", "left")
    return both.select("pattern", "did_expand", F.coalesce("rows", "n", F.lit(0)).cast("bigint").alias("match_count"), F.coalesce("lb", F.lit(0)).alias("block_aln_pos"), F.coalesce("off", F.lit(0)).alias("match_offset"), F.coalesce("matches", F.lit("")).alias("matches"))


def rows_through(paths: DataFrame, chosen: DataFrame, every: bool) -> DataFrame:
    """Rows through any (or every) of the chosen nodes (node_idx): seq_id."""
    nodes = chosen.select("node_idx").distinct()
    own = node_sets(paths.join(nodes, "node_idx"))
    if not every:
        return R.members(R.united(own, []), [])
    return R.members(R.common(own, [], nodes.count()), [])
