"""Block graphs: distinct ungapped segments of each block, the rows through them, edges between neighbouring blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.order import numbered, running_sum


def block_rows(ranked: DataFrame, seg: DataFrame) -> DataFrame:
    """block_idx, seq_id, label: each row's ungapped slice of each block.

    Cells find their block through a running maximum over starts (blocks tile the columns),
    in place of a range join.
    """
    starts = seg.select(F.col("lb").cast("int").alias("col"), "block_idx")
    columns = ranked.select("col").distinct().join(starts, "col", "left")
    stretch = columns.withColumn("s", F.floor(F.col("col") / 4096))
    heads = stretch.groupBy("s").agg(F.max("block_idx").alias("h"))
    before = heads.select("s", F.max("h").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("block_idx").over(Window.partitionBy("s").orderBy("col"))
    of = stretch.withColumn("own", own).join(F.broadcast(before), "s").select("col", F.coalesce("own", "before").alias("block_idx"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "ch"))), lambda x: F.when(x["ch"] == "-", "").otherwise(x["ch"])), "")
    return ranked.join(of.hint("merge"), "col").groupBy("block_idx", "seq_id").agg(text.alias("label"))


def nodes(rows: DataFrame) -> DataFrame:
    """block_idx, node_rank, node_idx, label, label_len, is_shortest_prefix.

    Ranks are per block; global indices add a running sum of block heights, so that no window
    spans all nodes.  A label is a shortest prefix if no other label of its block is a proper
    prefix of it.
    """
    labels = rows.select("block_idx", "label").distinct()
    in_block = Window.partitionBy("block_idx").orderBy("label")
    ranked = labels.withColumn("node_rank", (F.row_number().over(in_block) - 1).cast("int"))
    base = running_sum(labels.groupBy("block_idx").agg(F.count("*").alias("h"), F.collect_set(F.length("label")).alias("lengths")), "block_idx", {"base": "h"})
    # a label's prefixes of the lengths that other labels of its block have
    shorter = ranked.join(base.select("block_idx", "lengths"), "block_idx").select("block_idx", "label", F.explode("lengths").alias("n")).where(F.col("n") < F.length("label"))
    prefixes = shorter.select("block_idx", "label", F.substring(F.col("label"), F.lit(1), F.col("n")).alias("p"))
    covered = prefixes.join(labels.select("block_idx", F.col("label").alias("p")), ["block_idx", "p"]).select("block_idx", "label").distinct().withColumn("covered", F.lit(True))
    return (
        ranked.join(base.select("block_idx", "base"), "block_idx")
        .join(covered, ["block_idx", "label"], "left")
        .select("block_idx", "node_rank", (F.col("base") + F.col("node_rank")).cast("bigint").alias("node_idx"), "label", F.length("label").alias("label_len"), F.col("covered").isNull().alias("is_shortest_prefix"))
    )


def node_paths(rows: DataFrame, found: DataFrame) -> DataFrame:
    """node_idx, seq_id."""
    return rows.join(found.select("block_idx", "label", "node_idx"), ["block_idx", "label"]).select("node_idx", "seq_id")


def blocks(found: DataFrame, seg: DataFrame) -> DataFrame:
    """block_idx, aligned_position, height, node_csum, node_label_length_csum."""
    each = found.groupBy("block_idx").agg(F.count("*").cast("int").alias("height"), F.sum("label_len").alias("len"))
    summed = running_sum(each, "block_idx", {"node_csum": "height", "node_label_length_csum": "len"})
    return summed.join(seg.select("block_idx", "lb"), "block_idx").select("block_idx", F.col("lb").cast("bigint").alias("aligned_position"), "height", "node_csum", "node_label_length_csum")


def sentinel(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """The row that closes a list of blocks: its number, the number of columns, height 0 and the totals."""
    totals = found.agg((F.max("block_idx") + 1).alias("block_idx"), F.count("*").alias("node_csum"), F.sum("label_len").cast("bigint").alias("node_label_length_csum"))
    size = ranked.agg((F.max("col") + 1).cast("bigint").alias("aligned_position"))
    return totals.crossJoin(size).select("block_idx", "aligned_position", F.lit(0).alias("height"), "node_csum", "node_label_length_csum")  # one row each


def support_vectors(found: DataFrame, links: DataFrame, edge_order: DataFrame, graph_blocks: DataFrame) -> DataFrame:
    """vector, pos, value: the numbers of a path index, a row each.

    By name: ``X`` length and ``N`` block of the shortest-prefix labels in their order (by
    label, then block); ``B`` height and ``M`` first column of each block; ``I`` place of each
    node in the order of reversed labels; ``D`` the edges by alpha (their number); ``A``, ``R``
    source's rank and distance in node numbers by alpha; ``At``, ``L`` target's rank and that
    distance by alpha~.
    """
    spread = lambda df, pos, **values: df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("vector"), F.col(pos).cast("bigint").alias("pos"), F.col(v).cast("bigint").alias("value")) for k, v in values.items()))).alias("r")).select("r.*")
    short = numbered(found.where("is_shortest_prefix").select("label", "block_idx", "label_len"), ["label", "block_idx"], "pos")
    back = numbered(found.select(F.reverse("label").alias("back"), "block_idx", "node_idx"), ["back", "block_idx"], "pos")
    by_edge = links.select("block_idx", "lhs", "rhs", "lhs_idx", "rhs_idx", "rho_diff").join(edge_order.select("block_idx", "lhs", "rhs", "alpha", "alpha_tilde"), ["block_idx", "lhs", "rhs"])
    return (
        spread(short, "pos", X="label_len", N="block_idx")
        .unionByName(spread(back, "pos", I="node_idx"))
        .unionByName(spread(graph_blocks, "block_idx", B="height", M="aligned_position"))
        .unionByName(spread(by_edge, "alpha", D="lhs_idx", A="lhs", R="rho_diff"))
        .unionByName(spread(by_edge, "alpha_tilde", At="rhs", L="rho_diff"))
    )


def unary(values: DataFrame, order: str, value: str) -> DataFrame:
    """``values`` with mark: where each one's closing 1 stands in their unary code (``value`` zeros, then a 1), along the integers ``order``."""
    return running_sum(values, order, {"__b": value}).withColumn("mark", (F.col("__b") + F.col(value) + F.col(order)).cast("bigint")).drop("__b")


def left_neighbours(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """node_idx, tail, lhs_idx: sources of edges into the chosen nodes (node_idx, tail) whose label and the node's end with ``tail``."""
    met = links.join(chosen.select(F.col("node_idx").alias("rhs_idx"), "tail"), "rhs_idx").where(F.concat("lhs_label", "rhs_label").endswith(F.col("tail")))
    return met.select(F.col("rhs_idx").alias("node_idx"), "tail", "lhs_idx")


def right_edges(links: DataFrame, heads: DataFrame) -> DataFrame:
    """head, block_idx, lhs, rhs, lhs_idx, rhs_idx: edges whose labels, one after the other, start with each of the heads."""
    sizes = F.lit([r.n for r in heads.select(F.length("head").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")  # different lengths only
    text = F.concat("lhs_label", "rhs_label")
    cut = links.select("block_idx", "lhs", "rhs", "lhs_idx", "rhs_idx", text.alias("text"), F.explode(sizes).alias("n")).where(F.col("n") <= F.length("text"))
    return cut.withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("n"))).join(heads.select("head").distinct(), "head").select("head", "block_idx", "lhs", "rhs", "lhs_idx", "rhs_idx")


def edges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """block_idx (of the right end), lhs, rhs (ranks), lhs_idx, rhs_idx, rho_diff, lhs_label, rhs_label."""
    own = rows.join(found.select("block_idx", "label", "node_rank", "node_idx"), ["block_idx", "label"])
    step = Window.partitionBy("seq_id").orderBy("block_idx")
    pairs = own.select("block_idx", F.lag("node_rank").over(step).alias("lhs"), F.col("node_rank").alias("rhs"), F.lag("node_idx").over(step).alias("lhs_idx"), F.col("node_idx").alias("rhs_idx"), F.lag("label").over(step).alias("lhs_label"), F.col("label").alias("rhs_label"))
    return pairs.where("lhs IS NOT NULL").distinct().withColumn("rho_diff", F.col("rhs_idx") - F.col("lhs_idx"))


def stats(found: DataFrame, links: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of totals."""
    a = found.agg(F.count("*").alias("node_count"), F.sum("label_len").alias("node_label_length_sum"), F.max("label_len").alias("node_label_max_length"))
    b = links.agg(F.count("*").alias("edge_count"))
    c = ranked.agg((F.max("col") + 1).cast("bigint").alias("aligned_size"), F.count_distinct("seq_id").alias("input_count"))
    d = found.groupBy("block_idx").count().agg(F.max("count").alias("max_block_height"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def edge_ranks(links: DataFrame) -> DataFrame:
    """links with alpha (rank of lhs+rhs+'#') and alpha_tilde (rank of the reverse of lhs+rhs), from 0."""
    keyed = links.withColumn("__k", F.concat("lhs_label", "rhs_label", F.lit("#"))).withColumn("__t", F.reverse(F.concat("lhs_label", "rhs_label")))
    ties = ["block_idx", "lhs", "rhs"]
    return numbered(numbered(keyed, ["__k", *ties], "alpha"), ["__t", *ties], "alpha_tilde").drop("__k", "__t")


def indexable_lines(found: DataFrame, links: DataFrame) -> DataFrame:
    """The indexable text's parts in order: kind, block_idx, lhs, rhs, lhs_size, rhs_size, text, pos (its place among parts)."""
    first = found.where("block_idx = 0").select(F.lit("Segment").alias("kind"), "block_idx", F.col("node_rank").alias("lhs"), F.lit(None).cast("int").alias("rhs"), F.col("label_len").alias("lhs_size"), F.lit(None).cast("int").alias("rhs_size"), F.concat("label", F.lit("#")).alias("text"))
    rest = links.select(F.lit("Edge").alias("kind"), "block_idx", "lhs", "rhs", F.length("lhs_label").alias("lhs_size"), F.length("rhs_label").alias("rhs_size"), F.concat("lhs_label", "rhs_label", F.lit("#")).alias("text"))
    return first.unionByName(rest)


def text_offsets(lines: DataFrame) -> DataFrame:
    """Lines with off: where each part starts in the text, which begins with '#'. Sums in two levels, by block."""
    base = running_sum(lines.groupBy("block_idx").agg(F.sum(F.length("text")).alias("n")), "block_idx", {"base": "n"}).select("block_idx", (F.col("base") + 1).alias("base"))
    order = Window.partitionBy("block_idx").orderBy(F.coalesce("rhs", F.lit(-1)), "lhs")
    own = F.sum(F.length("text")).over(order) - F.length("text")
    return lines.withColumn("own", own).join(base, "block_idx").withColumn("off", (F.col("own") + F.col("base")).cast("bigint")).drop("own", "base")


def graphviz_lines(found: DataFrame, links: DataFrame) -> DataFrame:
    """line_no, line of a DOT file: head, nodes, edges, end."""
    quoted = F.replace("label", F.lit('"'), F.lit('\\"'))
    body = found.select(F.lit(1).alias("part"), "block_idx", F.lit(0).alias("a"), F.col("node_rank").alias("b"), F.format_string('\t_%d_%d [label = "%s"];', "block_idx", "node_rank", quoted).alias("line"))
    arrows = links.select(F.lit(2).alias("part"), "block_idx", F.col("lhs").alias("a"), F.col("rhs").alias("b"), F.format_string("\t_%d_%d -> _%d_%d;", F.col("block_idx") - 1, "lhs", "block_idx", "rhs").alias("line"))
    spark = found.sparkSession
    ends = spark.createDataFrame([(0, 0, 0, 0, "digraph block_graph {"), (0, 0, 0, 1, "\trankdir=LR;"), (3, 0, 0, 0, "}")], "part int, block_idx int, a int, b int, line string")
    return ends.unionByName(body).unionByName(arrows)
