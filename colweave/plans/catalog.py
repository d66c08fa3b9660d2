"""The catalogue of queries: each a DataFrame over the driver's tables, with a DuckDB statement for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.functions.order import numbered
from colweave.functions.scratch import present, settle, ship
from colweave.operators import alignment as A
from colweave.operators import find as Q
from colweave.operators import graph as B
from colweave.operators import merge as M
from colweave.operators import ranges as N
from colweave.operators import segmentation as G
from colweave.operators import suffixes as S
from colweave.operators import text as X
from colweave.operators import tools as T
from colweave.operators import tree as R
from colweave.plans.oracle import sql
from colweave.sources.alignments import derived_cells

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The derived alignment's tables for a folder's present files, each computed once when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._known = spark, sf_dir.rstrip("/"), {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._known or not present(self._known[name]):
            self._known[name] = settle(make(), name)
        return self._known[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def cells(self) -> DataFrame:
        return derived_cells(self.spark, self.dir)

    @property
    def ranked(self) -> DataFrame:
        return self._once("ranked", lambda: A.with_rank(self.cells))

    def columns(self, lb: int, rb: int) -> DataFrame:
        """seq_id, seq: columns [lb, rb) of the aligned rows; no other column is read into them."""
        return A.rows_of(self.cells.where(F.col("col").between(lb, rb - 1)))

    @property
    def prefixes(self) -> DataFrame:
        return self._once("prefixes", lambda: G.unique_prefixes(self.ranked))

    @property
    def raw(self) -> DataFrame:
        return self._once("raw", lambda: G.right_bounds(self.ranked, self.prefixes))

    @property
    def seg(self) -> DataFrame:
        return self._once("seg", lambda: G.max_blocks(self.raw))

    @property
    def rows(self) -> DataFrame:
        return self._once("block-rows", lambda: B.block_rows(self.ranked, self.seg))

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: B.nodes(self.rows))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: B.edges(self.rows, self.nodes))

    @property
    def paths(self) -> DataFrame:
        return B.node_paths(self.rows, self.nodes)

    @property
    def lines(self) -> DataFrame:
        return self._once("lines", lambda: B.text_offsets(B.indexable_lines(self.nodes, self.edges)))

    @property
    def names(self) -> DataFrame:
        return self.read("part").where("p_name IS NOT NULL").select(F.col("p_partkey").cast("bigint").alias("text_id"), F.col("p_name").alias("s"))

    @property
    def order(self) -> DataFrame:
        return self._once("order", lambda: X.suffix_array(self.names))

    @property
    def back_order(self) -> DataFrame:
        return self._once("back-order", lambda: X.suffix_array(self.names.select("text_id", F.reverse("s").alias("s"))))

    @property
    def rows_order(self) -> DataFrame:
        """The order of the ungapped rows."""
        return self._once("rows-order", lambda: S.cell_order(self.ranked))

    def rank_tables(self, order: DataFrame, last: DataFrame, name: str) -> N.RankTables:
        built: list[N.RankTables] = []

        def part(k: int) -> DataFrame:
            if not built:
                built.append(N.rank_tables(order, last))
            return (built[0].blocks, built[0].symbols)[k]

        return N.RankTables(self._once(f"{name}-blocks", lambda: part(0)), self._once(f"{name}-symbols", lambda: part(1)))

    @property
    def patterns(self) -> DataFrame:
        """Slices of the first row, and two strangers."""
        # the first 400 characters, by their ranks
        s = self.ranked.where("seq_id = 0 AND nb < 400 AND ch <> '-'").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "ch"))), lambda x: x["ch"]), "").alias("s"))
        cut = s.select("s", F.explode(F.sequence(F.lit(1), F.lit(179), F.lit(23))).alias("p")).withColumn("l", F.explode(F.lit([3, 6, 9, 14, 30])))
        own = cut.select(F.substring(F.col("s"), F.col("p"), F.col("l")).alias("pattern"))
        return own.unionByName(self.spark.createDataFrame([("ACGTTGCAACGT",), ("GG",)], "pattern string")).distinct()


_KNOWN: dict[tuple, Tables] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells the state of the files that ``Tables`` are derived from: names, sizes and times of change."""
    files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/part.parquet").select("path", "length", F.col("modificationTime").cast("double").alias("time"))
    one = files.agg(F.count("*"), F.sum("length"), F.max("time"), F.bit_xor(F.xxhash64("path", "length", "time"))).first()
    return tuple(one)


def forget() -> None:
    """Let the next query compute all that it needs."""
    _KNOWN.clear()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a folder, shared by queries of one application as long as its files stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _stamp(spark, sf_dir))
    if key not in _KNOWN:
        for old in [k for k in _KNOWN if k[:2] == key[:2] or k[0] != key[0]]:
            del _KNOWN[old]
        _KNOWN[key] = Tables(spark, sf_dir)
    t = _KNOWN[key]
    t.spark = spark
    return t


def query(final: str | None):
    """Register a query under its function's name, with the statement that ``final`` becomes."""

    def register(f):
        name = f.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(tables(spark, sf_dir))

        QUERIES[name] = run
        if final:
            ORACLES[name] = sql(final)
        return f

    return register


@query("SELECT lb, rb FROM raw")
def block_boundaries(t: Tables) -> DataFrame:
    return t.raw


@query("SELECT col, seq_id, nb, dd.d FROM (SELECT col, seq_id, nb FROM ranked) m LEFT JOIN dd USING (col, seq_id, nb)")
def unique_prefix_len(t: Tables) -> DataFrame:
    return t.prefixes


@query("SELECT lb AS col FROM raw WHERE rb IS NOT NULL")
def valid_columns(t: Tables) -> DataFrame:
    return t.raw.where("rb IS NOT NULL").select(F.col("lb").alias("col"))


@query("SELECT seq_id, replace(substr(seq, 11, 40), '-', '') AS seq FROM msa")
def degap(t: Tables) -> DataFrame:
    return t.columns(10, 50).select("seq_id", A.degap(F.col("seq")).alias("seq"))


@query("SELECT seq_id, CAST(sum(CASE WHEN ch = '-' THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(*) AS length FROM cells GROUP BY seq_id")
def gap_counts(t: Tables) -> DataFrame:
    return A.gap_counts(t.cells)


@query("SELECT seq_id, col, nb FROM ranked")
def gap_rank(t: Tables) -> DataFrame:
    return A.with_rank(t.cells).select("seq_id", "col", "nb")


@query("SELECT seq_id, nb + 1 AS k, col FROM ranked WHERE ch <> '-'")
def gap_select(t: Tables) -> DataFrame:
    return A.gap_select(t.ranked)


@query("SELECT lb, rb + 1 AS rb, rb - lb + 1 AS len FROM raw WHERE rb IS NOT NULL")
def valid_blocks(t: Tables) -> DataFrame:
    return t.raw.where("rb IS NOT NULL").select("lb", (F.col("rb") + 1).alias("rb"), (F.col("rb") - F.col("lb") + 1).alias("len"))


@query("SELECT CAST(a.seq_id AS INT) AS a, CAST(b.seq_id AS INT) AS b, CASE WHEN replace(substr(a.seq, 1, 30), '-', '') < replace(substr(b.seq, 1, 30), '-', '') THEN -1 WHEN replace(substr(a.seq, 1, 30), '-', '') = replace(substr(b.seq, 1, 30), '-', '') THEN 0 ELSE 1 END AS cmp FROM msa a JOIN msa b ON b.seq_id = (a.seq_id + 1) % 8")
def gap_insensitive_cmp(t: Tables) -> DataFrame:
    m = t.columns(0, 30)
    other = m.select(F.col("seq_id").alias("b"), F.col("seq").alias("o"))
    return m.join(other, (F.col("seq_id") + 1) % 8 == F.col("b")).select(F.col("seq_id").alias("a"), "b", A.gap_insensitive_order(F.col("seq"), F.col("o")).alias("cmp"))


@query("SELECT a.lb AS lb, CASE WHEN a.rb + 1 <= b.lb OR b.rb + 1 <= a.lb THEN 'DISJOINT' WHEN a.lb <= b.lb AND b.rb <= a.rb THEN 'INCLUDES' WHEN a.lb <= b.lb THEN 'LEFT' ELSE 'RIGHT' END AS overlap FROM raw a JOIN raw b ON b.lb = a.lb + 5 WHERE a.rb IS NOT NULL AND b.rb IS NOT NULL")
def range_overlap(t: Tables) -> DataFrame:
    v = t.raw.where("rb IS NOT NULL")
    o = v.select((F.col("lb") - 5).alias("lb"), F.col("lb").alias("lb2"), F.col("rb").alias("rb2"))
    return v.join(o, "lb").select("lb", A.range_overlap(F.col("lb"), F.col("rb") + 1, F.col("lb2"), F.col("rb2") + 1).alias("overlap"))


@query("SELECT lb + 3 AS lb, rb + 1 - 3 AS rb FROM raw WHERE rb + 1 - lb >= 6")
def padded_ranges(t: Tables) -> DataFrame:
    return T.padded_ranges(t.raw.where("rb IS NOT NULL").select("lb", (F.col("rb") + 1).alias("rb")), 3)


@query("SELECT rb - lb + 1 AS len, count(*) AS n FROM raw GROUP BY ALL")
def length_histogram(t: Tables) -> DataFrame:
    return T.length_histogram(t.raw)


@query("SELECT rb - lb AS len, count(*) AS n FROM seg GROUP BY ALL")
def opt_length_histogram(t: Tables) -> DataFrame:
    return t.seg.groupBy((F.col("rb") - F.col("lb")).alias("len")).agg(F.count("*").alias("n"))


@query("SELECT rb, count(*) AS n FROM raw WHERE rb IS NOT NULL GROUP BY rb")
def right_bound_histogram(t: Tables) -> DataFrame:
    return T.right_bound_histogram(t.raw)


@query("SELECT min(len) AS min_len, max(len) AS max_len, CAST(sum(len * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean_len, min(CASE WHEN cum >= total // 2 THEN len END) AS median_len FROM (SELECT len, n, sum(n) OVER (ORDER BY len) AS cum, sum(n) OVER () AS total FROM (SELECT rb - lb + 1 AS len, count(*) AS n FROM raw WHERE rb IS NOT NULL GROUP BY 1))")
def length_summary(t: Tables) -> DataFrame:
    return T.length_summary(T.length_histogram(t.raw))


@query("SELECT CAST(row_number() OVER (ORDER BY rb DESC, lb DESC) AS INT) AS pos, lb, rb FROM ivs")
def intervals_by_rb(t: Tables) -> DataFrame:
    half = t.raw.where("rb IS NOT NULL").select("lb", (F.col("rb") + 1).alias("rb"))
    return numbered(half, [F.desc("rb"), F.desc("lb")], "pos").select((F.col("pos") + 1).cast("int").alias("pos"), "lb", "rb")


@query("SELECT block_idx, lb, rb FROM seg")
def max_blocks(t: Tables) -> DataFrame:
    return G.max_blocks(t.raw)


@query("SELECT list_extract(best, 1) AS min_max_len FROM least WHERE a = 0")
def min_max_block_len(t: Tables) -> DataFrame:
    return G.min_longest_block(t.raw)


@query("SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INT) AS block_idx, a AS lb, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(lb) + 1 FROM raw)) AS rb FROM shortchain WHERE a <= (SELECT max(lb) FROM raw)")
def min_longest_blocks(t: Tables) -> DataFrame:
    return G.min_longest_blocks(t.raw)


@query("SELECT s.block_idx, s.lb, s.rb, coalesce(s.rb >= r.rb + 1, false) AS ok FROM (SELECT block_idx, lb, rb FROM seg UNION ALL SELECT block_idx + 1000000, lb + 1, lb + 3 FROM seg) s LEFT JOIN raw r ON r.lb = s.lb")
def check_segmentation(t: Tables) -> DataFrame:
    wrong = t.seg.select((F.col("block_idx") + 1000000).alias("block_idx"), (F.col("lb") + 1).alias("lb"), (F.col("lb") + 3).alias("rb"))
    return G.check_segmentation(t.seg.unionByName(wrong), t.raw)


@query("SELECT block_idx, label, count(*) AS n FROM brows GROUP BY ALL")
def block_segments(t: Tables) -> DataFrame:
    return t.rows.groupBy("block_idx", "label").agg(F.count("*").alias("n"))


@query("SELECT block_idx, label, string_agg(CAST(seq_id AS VARCHAR), ',' ORDER BY seq_id) AS inputs FROM brows GROUP BY ALL")
def segment_inputs(t: Tables) -> DataFrame:
    return t.rows.groupBy("block_idx", "label").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("inputs"))


@query("SELECT block_idx, node_rank, label FROM nodes")
def node_ranks(t: Tables) -> DataFrame:
    return t.nodes.select("block_idx", "node_rank", "label")


@query("SELECT block_idx, node_rank, node_idx, label, label_len, is_shortest_prefix FROM nodes")
def graph_nodes(t: Tables) -> DataFrame:
    return B.nodes(t.rows)


@query("SELECT block_idx, label FROM nodes WHERE is_shortest_prefix")
def shortest_prefix_labels(t: Tables) -> DataFrame:
    return t.nodes.where("is_shortest_prefix").select("block_idx", "label")


@query("SELECT block_idx, aligned_position, height, node_csum, node_label_length_csum FROM blocks")
def graph_blocks(t: Tables) -> DataFrame:
    return B.blocks(t.nodes, t.seg)


@query("SELECT block_idx, node_csum, node_label_length_csum FROM blocks")
def block_csums(t: Tables) -> DataFrame:
    return B.blocks(t.nodes, t.seg).select("block_idx", "node_csum", "node_label_length_csum")


@query("SELECT block_idx, lhs, rhs, lhs_idx, rhs_idx FROM edges")
def graph_edges(t: Tables) -> DataFrame:
    return B.edges(t.rows, t.nodes).select("block_idx", "lhs", "rhs", "lhs_idx", "rhs_idx")


@query("SELECT e.block_idx, lhs, rhs, rhs + h.height - lhs AS rho_diff FROM edges e JOIN heights h ON h.block_idx = e.block_idx - 1")
def rho_diff(t: Tables) -> DataFrame:
    return t.edges.select("block_idx", "lhs", "rhs", "rho_diff")


@query("SELECT (SELECT count(*) FROM nodes) AS node_count, CAST((SELECT sum(label_len) FROM nodes) AS BIGINT) AS node_label_length_sum, (SELECT max(label_len) FROM nodes) AS node_label_max_length, (SELECT count(*) FROM edges) AS edge_count, CAST((SELECT max(col) + 1 FROM cells) AS BIGINT) AS aligned_size, (SELECT count(DISTINCT seq_id) FROM cells) AS input_count, (SELECT max(height) FROM heights) AS max_block_height")
def graph_stats(t: Tables) -> DataFrame:
    return B.stats(t.nodes, t.edges, t.ranked)


@query("SELECT block_idx, lhs, rhs, row_number() OVER (ORDER BY lhs_label || rhs_label || '#', block_idx, lhs, rhs) - 1 AS alpha FROM edges")
def edge_alpha(t: Tables) -> DataFrame:
    return B.edge_ranks(t.edges).select("block_idx", "lhs", "rhs", "alpha")


@query("SELECT block_idx, lhs, rhs, row_number() OVER (ORDER BY reverse(lhs_label || rhs_label), block_idx, lhs, rhs) - 1 AS alpha_tilde FROM edges")
def edge_alpha_tilde(t: Tables) -> DataFrame:
    return B.edge_ranks(t.edges).select("block_idx", "lhs", "rhs", "alpha_tilde")


@query("SELECT off, text FROM offs")
def indexable_text(t: Tables) -> DataFrame:
    """The text in order, a row for each part: at scale it is written part by part."""
    return t.lines.select("off", "text")


@query("SELECT off, reverse(text) AS text FROM (SELECT CAST((SELECT sum(length(text)) FROM parts) + 1 - off - length(text) AS BIGINT) AS off, text FROM offs) q")
def reverse_text(t: Tables) -> DataFrame:
    total = t.lines.agg(F.sum(F.length("text")).alias("n"))
    return t.lines.crossJoin(total).select((F.col("n") + 1 - F.col("off") - F.length("text")).alias("off"), F.reverse("text").alias("text"))


@query("SELECT kind, block_idx, off, lhs, rhs, lhs_size, rhs_size FROM offs")
def text_offsets(t: Tables) -> DataFrame:
    return B.text_offsets(B.indexable_lines(t.nodes, t.edges)).select("kind", "block_idx", "off", "lhs", "rhs", "lhs_size", "rhs_size")


@query("SELECT 'digraph block_graph {' AS line UNION ALL SELECT chr(9) || 'rankdir=LR;' UNION ALL SELECT '}' UNION ALL SELECT chr(9) || '_' || block_idx || '_' || node_rank || ' [label = \"' || label || '\"];' FROM nodes UNION ALL SELECT chr(9) || '_' || (block_idx - 1) || '_' || lhs || ' -> _' || block_idx || '_' || rhs || ';' FROM edges")
def graphviz_lines(t: Tables) -> DataFrame:
    return B.graphviz_lines(t.nodes, t.edges).select("line")


@query("SELECT p.node_idx, n.block_idx, n.label, string_agg(CAST(p.seq_id AS VARCHAR), ',' ORDER BY p.seq_id) AS rows, count(*) AS n FROM paths p JOIN nodes n USING (node_idx) GROUP BY ALL")
def describe_graph(t: Tables) -> DataFrame:
    rows = t.paths.groupBy("node_idx").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("rows"), F.count("*").alias("n"))
    return rows.join(t.nodes.select("node_idx", "block_idx", "label"), "node_idx")


@query("SELECT n.node_rank, n.label, n.label_len, string_agg(CAST(p.seq_id AS VARCHAR), ',' ORDER BY p.seq_id) AS rows FROM nodes n JOIN paths p USING (node_idx) WHERE n.block_idx = 3 GROUP BY ALL")
def inspect_block(t: Tables) -> DataFrame:
    own = t.nodes.where("block_idx = 3")
    return own.join(t.paths, "node_idx").groupBy("node_rank", "label", "label_len").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("rows"))


@query("SELECT DISTINCT seq_id FROM paths WHERE node_idx % 7 = 0 AND node_idx < 70")
def path_or(t: Tables) -> DataFrame:
    return Q.rows_through(t.paths, t.nodes.where("node_idx % 7 = 0 AND node_idx < 70"), every=False)


@query("SELECT seq_id FROM paths WHERE node_idx IN (SELECT node_idx FROM paths JOIN nodes USING (node_idx) WHERE seq_id = 3 AND block_idx <= 1) GROUP BY seq_id HAVING count(DISTINCT node_idx) = (SELECT count(DISTINCT block_idx) FROM nodes WHERE block_idx <= 1)")
def path_and(t: Tables) -> DataFrame:
    """Rows that run with row 3 through the first two blocks."""
    chosen = t.paths.where("seq_id = 3").join(t.nodes.where("block_idx <= 1"), "node_idx").select("node_idx")
    return Q.rows_through(t.paths, chosen, every=True)


@query("SELECT e.lhs_idx, e.rhs_idx, string_agg(CAST(a.seq_id AS VARCHAR), ',' ORDER BY a.seq_id) AS matches, count(*) AS n FROM edges e JOIN paths a ON a.node_idx = e.lhs_idx JOIN paths b ON b.node_idx = e.rhs_idx AND b.seq_id = a.seq_id GROUP BY ALL")
def match_paths(t: Tables) -> DataFrame:
    a, b = t.paths.select(F.col("node_idx").alias("lhs_idx"), "seq_id"), t.paths.select(F.col("node_idx").alias("rhs_idx"), "seq_id")
    both = t.edges.select("lhs_idx", "rhs_idx").join(a, "lhs_idx").join(b, ["rhs_idx", "seq_id"])
    return both.groupBy("lhs_idx", "rhs_idx").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ",").alias("matches"), F.count("*").alias("n"))


@query("SELECT DISTINCT h.head, e.block_idx, e.lhs, e.rhs FROM edges e JOIN (SELECT DISTINCT substr(pattern, 1, 5) AS head FROM pats) h ON starts_with(e.lhs_label || e.rhs_label, h.head)")
def right_edges(t: Tables) -> DataFrame:
    heads = t.patterns.select(F.substring("pattern", 1, 5).alias("head")).distinct()
    return B.right_edges(t.edges, heads).select("head", "block_idx", "lhs", "rhs")


@query("SELECT e.rhs_idx AS node_idx, c.tail, e.lhs_idx FROM edges e JOIN (SELECT node_idx, substr(label, -2) AS tail FROM nodes WHERE node_idx % 5 = 0) c ON c.node_idx = e.rhs_idx WHERE ends_with(e.lhs_label || e.rhs_label, c.tail)")
def left_neighbours(t: Tables) -> DataFrame:
    return B.left_neighbours(t.edges, t.nodes.where("node_idx % 5 = 0").select("node_idx", F.expr("substring(label, -2)").alias("tail")))


@query("""
SELECT 'X' AS vector, pos, CAST(label_len AS BIGINT) AS value FROM shortest UNION ALL SELECT 'N', pos, block_idx FROM shortest
UNION ALL SELECT 'I', row_number() OVER (ORDER BY reverse(label), block_idx) - 1, node_idx FROM nodes
UNION ALL SELECT 'B', block_idx, height FROM blocks UNION ALL SELECT 'M', block_idx, aligned_position FROM blocks
UNION ALL SELECT 'D', alpha, lhs_idx FROM ealpha UNION ALL SELECT 'A', alpha, lhs FROM ealpha UNION ALL SELECT 'R', alpha, rho_diff FROM ealpha
UNION ALL SELECT 'At', alpha_tilde, rhs FROM ealpha UNION ALL SELECT 'L', alpha_tilde, rho_diff FROM ealpha""")
def support_vectors(t: Tables) -> DataFrame:
    return B.support_vectors(t.nodes, t.edges, B.edge_ranks(t.edges), B.blocks(t.nodes, t.seg))


@query("SELECT block_idx, height, CAST(sum(height + 1) OVER (ORDER BY block_idx) - 1 AS BIGINT) AS mark FROM blocks")
def unary_heights(t: Tables) -> DataFrame:
    return B.unary(B.blocks(t.nodes, t.seg).select("block_idx", "height"), "block_idx", "height")


@query("SELECT max(block_idx) + 1 AS block_idx, (SELECT CAST(max(col) + 1 AS BIGINT) FROM cells) AS aligned_position, 0 AS height, count(*) AS node_csum, CAST(sum(label_len) AS BIGINT) AS node_label_length_csum FROM nodes")
def sentinel_block(t: Tables) -> DataFrame:
    return B.sentinel(t.nodes, t.ranked)


@query("SELECT seq_id, col, covered, coalesce(lag(covered, 1) OVER w, 0) AS lag1, coalesce(lag(covered, 2) OVER w, 0) AS lag2 FROM (SELECT seq_id, col, CAST(nb + CASE WHEN ch <> '-' THEN 1 ELSE 0 END AS INT) AS covered FROM ranked) WINDOW w AS (PARTITION BY seq_id ORDER BY col)")
def running_coverage(t: Tables) -> DataFrame:
    return T.running_coverage(t.ranked)


@query("SELECT seq_id, count(*) AS n FROM (SELECT seq_id FROM cells WHERE col < 3 UNION ALL SELECT seq_id + 4 FROM cells WHERE col = 0) GROUP BY seq_id HAVING count(*) > 1")
def repeated_ids(t: Tables) -> DataFrame:
    return T.repeated_ids(t.cells.where("col < 3").select("seq_id").unionByName(t.cells.where("col = 0").select((F.col("seq_id") + 4).alias("seq_id"))))


@query("SELECT lb, rb, length(bin(rb)) AS bits, CAST(((rb + 62) // 63) * 63 AS BIGINT) AS padded FROM raw WHERE rb > 0")
def bit_widths(t: Tables) -> DataFrame:
    return t.raw.where("rb > 0").select("lb", "rb", T.bits_needed(F.col("rb")).cast("bigint").alias("bits"), T.round_up(F.col("rb"), 63).alias("padded"))


@query("SELECT pattern, (SELECT count(*) FROM parts WHERE ends_with(text, pattern || '#')) AS n FROM pats")
def terminated_count(t: Tables) -> DataFrame:
    """Patterns at the end of the indexable text's parts."""
    texts = t.lines.select(F.col("off").alias("text_id"), F.col("text").alias("s"))
    counts = X.pattern_counts(texts, t.patterns.select(F.concat("pattern", F.lit("#")).alias("pattern")))
    return counts.select(F.expr("substring(pattern, 1, length(pattern) - 1)").alias("pattern"), "n")


@query("SELECT a.pattern, a.lb, a.rb, b.lb AS co_lb, b.rb AS co_rb FROM (SELECT pattern, min(idx) AS lb, max(idx) AS rb FROM sa JOIN kmers_ ON starts_with(suf, pattern) GROUP BY pattern) a JOIN (SELECT pattern, min(idx) AS lb, max(idx) AS rb FROM rsa JOIN kmers_ ON starts_with(suf, reverse(pattern)) GROUP BY pattern) b USING (pattern)")
def bidirectional_ranges(t: Tables) -> DataFrame:
    patterns = t.names.select(F.substring("s", 1, 3).alias("pattern")).unionByName(t.names.select(F.substring("s", 2, 4).alias("pattern"))).where("pattern <> ''").distinct()
    return X.bidirectional_ranges(t.names, patterns)


@query("SELECT block_idx, lhs, rhs FROM edges WHERE ends_with(lhs_label || rhs_label, 'TA')")
def suffix_match_edges(t: Tables) -> DataFrame:
    return t.edges.where(F.concat("lhs_label", "rhs_label").endswith("TA")).select("block_idx", "lhs", "rhs")


@query("SELECT coalesce(a.block_idx, b.block_idx) AS block_idx, coalesce(a.label, b.label) AS label, CASE WHEN b.block_idx IS NULL THEN 'LEFT' WHEN a.block_idx IS NULL THEN 'RIGHT' WHEN a.n = b.n THEN 'SAME' ELSE 'DIFFERENT' END AS status FROM (SELECT block_idx, label, count(*) AS n FROM brows GROUP BY ALL) a FULL JOIN (SELECT block_idx, label, count(*) AS n FROM brows WHERE seq_id <> 3 AND block_idx <> 2 GROUP BY ALL) b ON a.block_idx = b.block_idx AND a.label = b.label")
def compare_graphs(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy("block_idx", "label").agg(F.count("*").alias("n"))
    return T.compare(count(t.rows), count(t.rows.where("seq_id <> 3 AND block_idx <> 2")), ["block_idx", "label"])


@query("SELECT a.seq_id, count(*) FILTER (a.nb = b.nb AND (a.ch = '-') = (b.ch = '-')) AS same, count(*) FILTER (NOT (a.nb = b.nb AND (a.ch = '-') = (b.ch = '-'))) AS different FROM ranked a JOIN ranked2 b USING (seq_id, col) GROUP BY a.seq_id")
def compare_gap_index(t: Tables) -> DataFrame:
    index = lambda r: r.select("seq_id", "col", (F.col("ch") == "-").alias("gap"), "nb")
    other = A.with_rank(t.cells.withColumn("ch", F.when((F.col("col") + 3 * F.col("seq_id")) % 101 == 0, "-").otherwise(F.col("ch"))))
    c = T.compare(index(t.ranked), index(other), ["seq_id", "col"])
    return c.groupBy("seq_id").agg(F.count_if(F.col("status") == "SAME").alias("same"), F.count_if(F.col("status") != "SAME").alias("different"))


@query("SELECT t.key, coalesce(k.kept, '') AS kept FROM evt t LEFT JOIN (SELECT key, string_agg(substr(s, CAST(i AS BIGINT) + 1, 1), '' ORDER BY i) AS kept FROM (SELECT key, s, unnest(range(length(s))) AS i FROM evt) x WHERE NOT EXISTS (SELECT 1 FROM evr r WHERE r.key = x.key AND i >= r.lb AND i < r.rb) GROUP BY key) k ON k.key = t.key")
def remove_ranges(t: Tables) -> DataFrame:
    e = t.read("events").select(F.col("user_id").alias("key"), (F.col("event_id") % 19).alias("lb"), (F.col("event_id") % 19 + 1 + F.col("event_id") % 7).alias("rb"))
    texts = e.select("key").distinct().select("key", F.concat(F.lit("the quick brown fox "), F.col("key").cast("string")).alias("s"))
    return T.remove_ranges(texts, e)


@query("SELECT seq_id, run, any_value(v) AS ch, count(*) AS n FROM (SELECT seq_id, v, CAST(sum(fresh) OVER (PARTITION BY seq_id ORDER BY col) - 1 AS BIGINT) AS run FROM (SELECT seq_id, col, ch AS v, CASE WHEN ch = lag(ch) OVER (PARTITION BY seq_id ORDER BY col) THEN 0 ELSE 1 END AS fresh FROM cells)) GROUP BY seq_id, run")
def run_lengths(t: Tables) -> DataFrame:
    return X.run_lengths(t.cells, "seq_id", "col", "ch")


@query("SELECT lb, v >> 3 AS high, v & 7 AS low, (v >> 3) + lb AS mark FROM (SELECT lb, CAST(max(coalesce(rb, 0)) OVER (ORDER BY lb) AS BIGINT) AS v FROM raw)")
def elias_split(t: Tables) -> DataFrame:
    """The running maxima of right bounds."""
    most = t.raw.select("lb", F.coalesce("rb", F.lit(0)).alias("rb"))
    cut = most.withColumn("s", F.floor(F.col("lb") / 4096))
    tops = cut.groupBy("s").agg(F.max("rb").alias("top"))
    before = tops.select("s", F.max("top").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("rb").over(Window.partitionBy("s").orderBy("lb"))
    values = cut.withColumn("own", own).join(F.broadcast(before), "s").select("lb", F.greatest("own", "before").cast("bigint").alias("v"))
    return T.elias_split(values, "v", 3, "lb").select("lb", "high", "low", "mark")


@query("SELECT idx, text_id, pos FROM sa")
def suffix_array(t: Tables) -> DataFrame:
    return X.suffix_array(t.names).select("idx", "text_id", "pos")


@query("SELECT idx, CAST(CASE WHEN p IS NULL THEN 0 ELSE (SELECT count(*) FROM (SELECT unnest(range(1, least(length(suf), length(p)) + 1)) AS k) z WHERE substr(suf, 1, CAST(k AS BIGINT)) = substr(p, 1, CAST(k AS BIGINT))) END AS INT) AS lcp FROM (SELECT idx, suf, lag(suf) OVER (ORDER BY idx) AS p FROM sa)")
def lcp_array(t: Tables) -> DataFrame:
    return X.suffix_array(t.names).select("idx", "lcp")


@query("SELECT sa.idx, sa.text_id, sa.pos, sal.lcp FROM sa JOIN sal ON sa.idx = sal.idx")
def extended_suffix_array(t: Tables) -> DataFrame:
    """The order of the names of smaller parts, into which those of the larger ones are merged."""
    small = F.coalesce(F.col("p_size") <= 45, F.lit(True))
    names = t.read("part").where("p_name IS NOT NULL").select(F.col("p_partkey").cast("bigint").alias("text_id"), F.col("p_name").alias("s"), small.alias("small"))
    first, more = (names.where(w).select("text_id", "s") for w in ("small", "NOT small"))
    order = M.extended_order(settle(X.suffix_array(first), "order"), first, more)
    return order.select("idx", "text_id", "pos", "lcp")


@query("SELECT lb, rb, CAST(depth AS INT) AS depth, parent_lb, parent_rb, parent_depth FROM tup")
def suffix_tree_nodes(t: Tables) -> DataFrame:
    return R.suffix_tree(t.order)


@query("SELECT idx, prev_char AS ch FROM sa")
def bwt(t: Tables) -> DataFrame:
    return X.bwt(X.suffix_array(t.names))


@query("SELECT substr(suf, 1, 3) AS kmer, string_agg(DISTINCT prev_char, '' ORDER BY prev_char) AS symbols FROM sufs WHERE length(suf) >= 3 GROUP BY 1")
def left_extensions(t: Tables) -> DataFrame:
    return X.left_extensions(t.names, 3)


@query("SELECT pattern, (SELECT count(*) FROM (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM ungapped) u WHERE substr(s, p, length(pattern)) = pattern) AS n FROM pats")
def pattern_count(t: Tables) -> DataFrame:
    return X.pattern_counts(lambda size: S.cell_blocks(t.ranked, size), t.patterns)


@query("SELECT pattern, (SELECT count(*) FROM (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM ungapped) u WHERE substr(s, p, length(pattern)) = pattern) AS n FROM pats")
def stored_pattern_count(t: Tables) -> DataFrame:
    """The same counts from the order's tables alone."""
    last = t.ranked.where("ch <> '-'").groupBy("seq_id").agg(F.max_by("ch", "nb").alias("ch"))
    return N.stored_counts(t.patterns, t.rank_tables(t.rows_order, last, "rows"))


@query("SELECT a.pattern, a.lb, a.rb, b.lb AS co_lb, b.rb AS co_rb FROM (SELECT pattern, min(idx) AS lb, max(idx) AS rb FROM sa JOIN kmers_ ON starts_with(suf, pattern) GROUP BY pattern) a JOIN (SELECT pattern, min(idx) AS lb, max(idx) AS rb FROM rsa JOIN kmers_ ON starts_with(suf, reverse(pattern)) GROUP BY pattern) b USING (pattern)")
def alternating_ranges(t: Tables) -> DataFrame:
    """Both ranges of each pattern in step, extended from its middle to the left and to the right in turn."""
    patterns = t.names.select(F.substring("s", 1, 3).alias("pattern")).unionByName(t.names.select(F.substring("s", 2, 4).alias("pattern")))
    back = t.names.select("text_id", F.reverse("s").alias("s"))
    ahead, behind = t.rank_tables(t.order, N.last_symbols(t.names), "ahead"), t.rank_tables(t.back_order, N.last_symbols(back), "behind")
    return N.alternating_ranges(patterns, ahead, behind)


@query("SELECT * FROM found_")
def find_patterns_batch(t: Tables) -> DataFrame:
    return Q.find(t.patterns, t.ranked, t.seg, t.lines, t.nodes, t.edges, t.paths)


@query("SELECT * FROM found_ WHERE pattern = (SELECT max(pattern) FROM pats WHERE length(pattern) = 30)")
def find_pattern(t: Tables) -> DataFrame:
    one = t.patterns.where("length(pattern) = 30").agg(F.max("pattern").alias("pattern"))
    return Q.find(one, t.ranked, t.seg, t.lines, t.nodes, t.edges, t.paths)
