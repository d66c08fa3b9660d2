"""Indices as folders of Parquet tables: built, stored, loaded, described and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.functions.scratch import measured, settle, summed
from colweave.operators import alignment as A
from colweave.operators import find as Q
from colweave.operators import graph as B
from colweave.operators import merge as M
from colweave.operators import ranges as N
from colweave.operators import segmentation as G
from colweave.operators import text as X
from colweave.operators import tools as T

#: Tables of a whole index; those that can be left out, by the option that does.
TABLES = ("ranked", "seg", "nodes", "edges", "paths", "sets", "seeds", "blocks", "vectors", "lines", "ranks", "symbols", "back_ranks", "back_symbols")
OPTIONAL = {"paths": "skip_support", "sets": "skip_support", "seeds": "skip_support", "blocks": "skip_support", "vectors": "skip_support", "lines": "skip_text"} | dict.fromkeys(("ranks", "symbols", "back_ranks", "back_symbols"), "no ranks")


class Index(dict):
    """Tables by name; those that the build skipped aren't there."""

    def save(self, folder: str) -> None:
        for name in TABLES:
            if name in self:
                # a query reads the folders of its own seeds
                dealt = self[name].repartition("folder").sortWithinPartitions("folder", "seed").write.partitionBy("folder") if name == "seeds" else self[name].write
                dealt.mode("overwrite").parquet(f"{folder}/{name}")
        left_out = [(name,) for name in TABLES if name not in self]
        self["seg"].sparkSession.createDataFrame(left_out, "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/skipped")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        skipped = {r.name for r in spark.read.parquet(f"{folder}/skipped").collect()}
        return cls({name: spark.read.parquet(f"{folder}/{name}") for name in TABLES if name not in skipped})

    def __missing__(self, name: str) -> DataFrame:
        why = f": it was built with {OPTIONAL[name]}" if name in OPTIONAL else ""
        raise ValueError(f"the index has no table {name}{why}")

    @staticmethod
    def space(spark: SparkSession, folder: str) -> DataFrame:
        """table, files, bytes of a stored index."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        table = F.element_at(F.filter(F.split("path", "/"), lambda p: ~p.contains("=") & ~p.endswith(".parquet")), -1)
        return files.groupBy(table.alias("table")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def find(self, patterns: DataFrame) -> DataFrame:
        return Q.find(patterns, *(self[name] for name in ("ranked", "seg", "lines", "nodes", "edges", "paths", "seeds", "sets")))

    def count(self, patterns: DataFrame) -> DataFrame:
        """pattern, n: occurrences in the indexable text, from the stored order's blocks alone."""
        return N.stored_counts(patterns, N.RankTables(self["ranks"], self["symbols"]))

    def ranges(self, patterns: DataFrame) -> DataFrame:
        """pattern, lb, rb, co_lb, co_rb in the orders of the indexable text's parts and of the same reversed."""
        return N.alternating_ranges(patterns, N.RankTables(self["ranks"], self["symbols"]), N.RankTables(self["back_ranks"], self["back_symbols"]))

    def describe(self) -> DataFrame:
        """node_idx, block_idx, label, rows, n: the rows of each node."""
        rows = self["paths"].groupBy("node_idx").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("rows"), F.count("*").alias("n"))
        return self["nodes"].select("node_idx", "block_idx", "label").join(rows, "node_idx")


def build_index(cells: DataFrame, seg: DataFrame | None = None, *, skip_text: bool = False, skip_support: bool = False, ranks: bool = False, order: str | None = None, reverse_order: str | None = None, progress: Callable[[str], None] | None = None) -> Index:
    """All tables of an alignment and a segmentation (of most blocks, unless given); ``progress`` hears of each table that is written.

    With ``ranks`` the index has the rank blocks of its indexable text and of the reversed one.
    Both orders are sorted for it, or read from ``order`` and ``reverse_order`` (folders of
    ``save_suffix_order``), which have to be orders of these very texts.
    """
    stored = both_or_neither(order, reverse_order)

    def written(df: DataFrame, name: str) -> DataFrame:
        out = settle(df, name)
        if progress is not None:
            progress(name)
        return out

    ranked = written(A.with_rank(cells), "ranked")
    seg = written(G.max_blocks(written(G.find_block_boundaries(ranked), "raw")) if seg is None else seg, "seg")
    rows = written(B.block_rows(ranked, seg), "block-rows")
    nodes = written(B.nodes(rows), "nodes")
    edges = written(B.edges(rows, nodes), "edges")
    out = Index(ranked=ranked, seg=seg, rows=rows, nodes=nodes, edges=edges)
    if not skip_support:
        graph_blocks = written(B.blocks(nodes, seg), "blocks")
        paths = written(B.node_paths(rows, nodes), "paths")
        out |= {"paths": paths, "sets": written(Q.node_sets(paths), "sets"), "seeds": written(Q.seeds(nodes), "seeds"), "blocks": graph_blocks, "vectors": B.support_vectors(nodes, edges, B.edge_ranks(edges), graph_blocks)}
    if not skip_text or ranks or stored:
        lines = B.text_offsets(B.indexable_lines(nodes, edges))
        lines = written(lines, "lines") if ranks or stored else lines
        out |= {} if skip_text else {"lines": lines}
    if ranks or stored:
        for prefix, texts, folder in (("", indexed_texts(lines), order), ("back_", indexed_texts(lines, backwards=True), reverse_order)):
            tables = N.rank_tables(suffix_order_of(texts, folder), N.last_symbols(texts))
            out |= {f"{prefix}ranks": tables.blocks, f"{prefix}symbols": tables.symbols}
            if progress is not None:
                progress(f"{prefix}ranks")
    return out


def build_measured(cells: DataFrame, seg: DataFrame | None = None, **options) -> tuple[Index, DataFrame]:
    """An index, and what its build wrote: name, rounds, rows, bytes, seconds of the tables of each name, those between steps included."""
    with measured() as written:
        index = build_index(cells, seg, **options)
    return index, cells.sparkSession.createDataFrame(summed(written), "name string, rounds int, rows bigint, bytes bigint, seconds double")


def indexed_texts(lines: DataFrame, backwards: bool = False) -> DataFrame:
    """text_id, s: the parts of an indexable text, each for itself."""
    return lines.select(F.col("off").alias("text_id"), (F.reverse("text") if backwards else F.col("text")).alias("s"))


#: Columns that tell the rows of a table apart.
KEYS = {"ranked": ["seq_id", "col"], "seg": ["block_idx"], "nodes": ["block_idx", "label"], "edges": ["block_idx", "lhs", "rhs"], "paths": ["node_idx", "seq_id"], "sets": ["node_idx", "bucket"], "seeds": ["size", "node_idx", "offset"], "blocks": ["block_idx"], "vectors": ["vector", "pos"], "lines": ["off"], "ranks": ["blk"], "symbols": ["ch"], "back_ranks": ["blk"], "back_symbols": ["ch"]}


def compare_indices(left: Index, right: Index) -> DataFrame:
    """table, status, n: rows of all tables that either index has, by whether both have them (SAME, DIFFERENT, LEFT, RIGHT)."""
    out = None
    for name in TABLES:
        if name not in left and name not in right:
            continue
        one, other = (x[name] if name in x else (right if x is left else left)[name].limit(0) for x in (left, right))
        found = T.compare(one, other.select(one.columns), KEYS[name]).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "status", "n")
        out = found if out is None else out.unionByName(found)
    return out


def save_gap_index(cells: DataFrame, folder: str) -> None:
    """The gap index alone: seq_id, col, ch, nb."""
    A.with_rank(cells).write.mode("overwrite").partitionBy("seq_id").parquet(folder)


def load_gap_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("col int, ch string, nb int, seq_id int").parquet(folder).select("seq_id", "col", "ch", "nb")


def compare_gap_indices(left: DataFrame, right: DataFrame) -> DataFrame:
    """seq_id, same, different: cells of two stored gap indices."""
    index = lambda r: r.select("seq_id", "col", (F.col("ch") == "-").alias("gap"), "nb")
    c = T.compare(index(left), index(right), ["seq_id", "col"])
    return c.groupBy("seq_id").agg(F.count_if(F.col("status") == "SAME").alias("same"), F.count_if(F.col("status") != "SAME").alias("different"))


def _fingerprint(texts: DataFrame) -> DataFrame:
    """One row that tells the texts from others, whatever their order."""
    named = F.sha2(F.concat_ws(":", F.col("text_id").cast("string"), F.col("s")), 256)
    return texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("s")), F.lit(0)).cast("bigint").alias("suffixes"), F.coalesce(F.bit_xor(F.xxhash64(named)), F.lit(0)).alias("one"), F.coalesce(F.bit_xor(F.xxhash64(F.reverse(named))), F.lit(0)).alias("two"))


def save_suffix_order(order: DataFrame, folder: str, texts: DataFrame | None = None) -> None:
    """A suffix order by ranges of idx, so that parts hold consecutive ranks; with the fingerprint of its texts, if they are given."""
    order.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(f"{folder}/order")
    if texts is not None:
        _fingerprint(texts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/texts")


def load_suffix_order(spark: SparkSession, folder: str, lb: int = 0, rb: int | None = None) -> DataFrame:
    """Ranks [lb, rb) of a stored order, in order; files that hold other ranks only are passed over by their statistics."""
    rows = spark.read.parquet(f"{folder}/order").where(F.col("idx") >= lb)
    return (rows if rb is None else rows.where(F.col("idx") < rb)).orderBy("idx")


def suffix_order_of(texts: DataFrame, stored: str | None = None) -> DataFrame:
    """The suffix order of texts: a stored one, or a new one.

    A stored order of other texts raises: by the fingerprint that was stored with it, or else
    by the number of its suffixes.
    """
    if stored is None:
        return X.suffix_array(texts)
    spark = texts.sparkSession
    order, own = spark.read.parquet(f"{stored}/order"), _fingerprint(texts).first()
    known = spark._jvm.org.apache.hadoop.fs.Path(f"{stored}/texts")
    if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
        if tuple(spark.read.parquet(f"{stored}/texts").first()) != tuple(own):
            raise ValueError("the stored order is one of other texts")
    elif (have := order.count()) != own.suffixes:
        raise ValueError(f"the stored order has {have} suffixes, the texts have {own.suffixes}")
    return order


def extend_suffix_order(texts: DataFrame, added: DataFrame, stored: str, folder: str) -> DataFrame:
    """The stored order of ``texts`` with ``added`` ones, written to ``folder`` with the fingerprint of all of them, and read from it.

    ``folder`` is another one than ``stored``, whose ranks are read while it is written; a
    stored order of other texts raises.
    """
    if folder.rstrip("/") == stored.rstrip("/"):
        raise ValueError("an order isn't written over the one that it is made from")
    both = texts.select("text_id", "s").unionByName(added.select("text_id", "s"))
    save_suffix_order(M.extended_order(suffix_order_of(texts, stored), texts, added), folder, both)
    return texts.sparkSession.read.parquet(f"{folder}/order")


def both_or_neither(forward: str | None, reverse: str | None) -> bool:
    """Whether stored forward and reverse texts are given; one without the other raises."""
    if (forward is None) != (reverse is None):
        raise ValueError("a stored forward text needs a stored reverse text, and the other way round")
    return forward is not None
