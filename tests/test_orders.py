"""The tree over a suffix order, stored rank blocks, synchronised ranges and the least longest block, over many small parts."""

import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import ranges as N
from colweave.operators import segmentation as G
from colweave.operators import suffixes as S
from colweave.operators import text as X
from colweave.operators import tree as R

WORDS = [(0, "banana"), (1, "bandana"), (2, ""), (3, "banana"), (4, "ab" * 20 + "c" + "ab" * 20), (5, "$é$日é"), (6, "n"), (7, "aaaaaaaaaa")]


@pytest.fixture(scope="module")
def order(spark):
    """The suffixes of WORDS in order, and the stored table of that order."""
    texts = spark.createDataFrame(WORDS, "text_id bigint, s string")
    return sorted((s[p:], i, p) for i, s in WORDS for p in range(len(s))), S.suffix_order(texts).cache(), texts


def _nodes(lcp):
    """lb, rb, depth of every node by definition."""
    n, out = len(lcp), set()
    for i in range(1, n):
        lb = next(j for j in range(i - 1, -1, -1) if j == 0 or lcp[j] < lcp[i])
        rb = next((j - 1 for j in range(i + 1, n) if lcp[j] < lcp[i]), n - 1)
        out.add((lb, rb, lcp[i]))
    return out


def _parent(a, z, nodes):
    around = [(rb - lb, -d, lb, rb) for lb, rb, d in nodes if lb <= a and z <= rb and (lb, rb) != (a, z)]
    return min(around)[2:] if around else (None, None)


@pytest.mark.parametrize(("stretch", "fan"), [(7, 3), (65_536, 256)])
def test_tree(order, stretch, fan):
    _, stored, _ = order
    around = R.surroundings(stored, stretch, fan)
    lcp = [r.lcp for r in stored.orderBy("idx").collect()]
    nodes = _nodes(lcp)
    got = R.suffix_tree(stored, around).collect()
    assert len(got) == len(nodes) and {(r.lb, r.rb, r.depth) for r in got} == nodes
    depth = {(lb, rb): d for lb, rb, d in nodes}
    for r in got:
        assert (r.parent_lb, r.parent_rb) == _parent(r.lb, r.rb, nodes)
        assert r.parent_depth == depth.get((r.parent_lb, r.parent_rb))
    leaves = R.leaves(stored, around).collect()
    assert len(leaves) == len(lcp)
    for r in leaves:
        assert (r.parent_lb, r.parent_rb) == _parent(r.idx, r.idx, nodes)


@pytest.mark.parametrize("seed", range(2))
def test_tree_of_random_numbers(spark, seed):
    """Any numbers will do: long plateaus, falls and rises over many levels of groups."""
    r = random.Random(seed)
    v = [0] + [r.choice([0, 1, 2, 3, 50]) if seed else 100 - abs(k - 40) for k in range(80)]
    stored = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "idx bigint, lcp int")
    assert {(r.lb, r.rb, r.depth) for r in R.suffix_tree(stored, R.surroundings(stored, 5, 4)).collect()} == _nodes(v)


def test_tree_of_few_suffixes(spark):
    empty = spark.createDataFrame([], "idx bigint, lcp int")
    assert R.suffix_tree(empty).collect() == []
    assert R.suffix_tree(spark.createDataFrame([(0, 0)], "idx bigint, lcp int")).collect() == []
    two = R.suffix_tree(spark.createDataFrame([(0, 0), (1, 3)], "idx bigint, lcp int")).collect()
    assert [tuple(x) for x in two] == [(0, 1, 3, None, None, None)]


def _asked(rows):
    r = random.Random(2)
    some = {s[a : a + n] for s, _, _ in rows for a in (0,) for n in (1, 2, 3, 5, 9) if s[a : a + n]}
    return sorted(some) + ["zz", "bananab", "ab" * 7, "日é", "$", "x" + "ab" * 3] + ["".join(r.choice("abn") for _ in range(4)) for _ in range(20)]


@pytest.mark.parametrize(("width", "part"), [(4, 12), (512, 1 << 17)])
def test_stored_ranges(spark, order, tmp_path, width, part):
    rows, stored, texts = order
    N.rank_tables(stored, N.last_symbols(texts), width, part).save(str(tmp_path / "t"))
    tables = N.RankTables.load(spark, str(tmp_path / "t"))
    assert tables.width == width and tables.blocks.count() == len(rows) // width + 1
    asked = _asked(rows)
    patterns = spark.createDataFrame([(p,) for p in [*asked, asked[0], ""]], "pattern string")
    want = {p: [k for k, (s, _, _) in enumerate(rows) if s.startswith(p)] for p in asked}
    got = {r.pattern: (r.lb, r.rb) for r in N.stored_ranges(patterns, tables).collect()}
    assert got == {p: (w[0], w[-1]) for p, w in want.items() if w}
    counts = {r.pattern: r.n for r in N.stored_counts(patterns, tables).collect()}
    assert counts == {p: len(w) for p, w in want.items()} | {"": 0}


def test_stored_ranges_read_no_texts(spark, order):
    rows, stored, texts = order
    tables = N.rank_tables(stored, N.last_symbols(texts), 4, 12)
    known = {f.rsplit("/", 2)[-2] for t in (tables.blocks, tables.symbols) for f in t.inputFiles()}
    step = N.extended(tables, spark.createDataFrame([("n", 0, len(rows) - 1)], "c string, lb bigint, rb bigint"))
    assert {f.rsplit("/", 2)[-2] for f in step.inputFiles()} == known and step.count() == 1


@pytest.mark.parametrize(("width", "part"), [(4, 12)])
def test_alternating_ranges(spark, order, width, part):
    rows, stored, texts = order
    back_rows = sorted((s[::-1][p:], i, p) for i, s in WORDS for p in range(len(s)))
    back = texts.select("text_id", F.reverse("s").alias("s"))
    ahead, behind = N.rank_tables(stored, N.last_symbols(texts), width, part), N.rank_tables(S.suffix_order(back), N.last_symbols(back), width, part)
    asked = _asked(rows)
    got = {r.pattern: (r.lb, r.rb, r.co_lb, r.co_rb) for r in N.alternating_ranges(spark.createDataFrame([(p,) for p in asked], "pattern string"), ahead, behind).collect()}
    want = {}
    for p in asked:
        at, co = ([k for k, (s, _, _) in enumerate(x) if s.startswith(w)] for x, w in ((rows, p), (back_rows, p[::-1])))
        if at:
            want[p] = (at[0], at[-1], co[0], co[-1])
    assert got == want


def test_cell_order(spark):
    rows = [(0, "AC-GTA--CGT"), (1, "-CAGTAAACG-"), (2, "-----------"), (3, "ACGTACGTACG")]
    ranked = spark.createDataFrame([(i, k, c, len(s[:k].replace("-", ""))) for i, s in rows for k, c in enumerate(s)], "seq_id int, col int, ch string, nb int")
    texts = spark.createDataFrame([(i, s.replace("-", "")) for i, s in rows], "text_id bigint, s string")
    take = lambda df: df.select("idx", "text_id", "pos", "lcp", "ch").orderBy("idx").collect()
    assert take(S.cell_order(ranked, 3)) == take(X.suffix_array(texts))


def _least(ivs, total):
    best = {total: 0}
    for a, e in sorted(ivs, reverse=True):
        after = [max(y - a, b) for y, b in best.items() if y >= e]
        if after:
            best[a] = min(after)
    return best.get(0)


@pytest.mark.parametrize(("seed", "stretch", "many"), [(1, 8, 3), (2, 16, 16), (3, 8, 16)])
def test_least_longest_block_over_stretches(spark, seed, stretch, many):
    r = random.Random(seed)
    n = r.randint(60, 120)
    far = (3, 6, 9, 40, 12, 20)[seed]
    ivs = [(a, min(n, a + r.randint(1, far))) for a in range(n) if a == 0 or r.random() < 0.5]
    if seed == 1:  # stretches without a start
        ivs = [(a, e) for a, e in ivs if not 20 <= a < 45]
    raw = spark.createDataFrame([(a, {x: e - 1 for x, e in ivs}.get(a)) for a in range(n)], "lb bigint, rb bigint")
    got = [tuple(x) for x in G.min_longest_blocks(raw, stretch, many).orderBy("block_idx").collect()]
    assert got[0][:2] == (0, 0) and got[-1][2] == n and [x[0] for x in got] == list(range(len(got)))
    assert all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert all(b >= dict(ivs)[a] for _, a, b in got)
    assert max(b - a for _, a, b in got) == _least(ivs, n)


def test_no_segmentation(spark):
    raw = spark.createDataFrame([(k, 5 if k else None) for k in range(6)], "lb bigint, rb bigint")
    with pytest.raises(ValueError):
        G.min_longest_blocks(raw, 4)
