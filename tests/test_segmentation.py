"""Prefixes, right bounds and optimal segmentations against brute force on random alignments."""

import random
import re

import pytest

from colweave.operators import alignment as A
from colweave.operators import find as Q
from colweave.operators import graph as B
from colweave.operators import segmentation as G
from colweave.plans.index import TABLES, Index, both_or_neither, build_index, compare_gap_indices, compare_indices, indexed_texts, load_gap_index, load_suffix_order, save_gap_index, save_suffix_order, suffix_order_of
from colweave.streaming.patterns import answer, pattern_stream


def brute_bounds(rows):
    bare, out = [r.replace("-", "") for r in rows], {}
    for x in range(len(rows[0])):
        members = [(j, len(r[:x].replace("-", ""))) for j, r in enumerate(rows)]
        ends = []
        for j, p in members:
            tail = bare[j][p:]
            d = next((n for n in range(1, len(tail) + 1) if all((i, q) in members for i, u in enumerate(bare) for q in range(len(u) - n + 1) if u[q : q + n] == tail[:n])), None)
            ends.append(None if d is None else [i for i, c in enumerate(rows[j]) if c != "-"][p + d - 1])
        out[x] = None if None in ends else max(ends)
    return out


def brute_optimum(raw, n):
    """Most blocks and least longest block, by dynamic programming from the right."""
    ivs = sorted(((a, b + 1) for a, b in raw.items() if b is not None), reverse=True)
    most, least = {n: 0}, {n: 0}
    for a, e in ivs:
        after = [y for y in most if y >= e]
        if after:
            most[a] = 1 + max(most[y] for y in after)
            least[a] = min(max(y - a, least[y]) for y in after)
    return most.get(0), least.get(0)


def random_rows(seed):
    r = random.Random(seed)
    m, n = r.randint(2, 5), r.randint(6, 26)
    base = [r.choice("ACGT") for _ in range(n)]
    return ["".join("-" if r.random() < 0.15 else r.choice("ACGT") if r.random() < 0.15 else b for b in base) for _ in range(m)]


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    ranked = A.with_rank(A.cells_of(spark.createDataFrame(list(enumerate(rows)), "seq_id int, seq string"))).cache()
    raw = G.find_block_boundaries(ranked, 4).cache()
    got, want = {r.lb: r.rb for r in raw.collect()}, brute_bounds(rows)
    assert got == want
    most, least = brute_optimum(want, len(rows[0]))
    if most is None:
        with pytest.raises(ValueError):
            G.max_blocks(raw)
        with pytest.raises(ValueError):
            G.min_longest_block(raw)
        return
    seg = [tuple(r) for r in G.max_blocks(raw).orderBy("block_idx").collect()]
    assert len(seg) == most and seg[0][1] == 0 and seg[-1][2] == len(rows[0])
    assert all(a[2] == b[1] for a, b in zip(seg, seg[1:], strict=False))
    assert all(want[lb] is not None and rb >= want[lb] + 1 for _, lb, rb in seg)
    assert G.min_longest_block(raw).first()[0] == least
    short = [tuple(r) for r in G.min_longest_blocks(raw).orderBy("block_idx").collect()]
    assert short[0][1] == 0 and short[-1][2] == len(rows[0]) and max(b - a for _, a, b in short) == least
    assert all(a[2] == b[1] for a, b in zip(short, short[1:], strict=False))
    assert all(want[lb] is not None and rb >= want[lb] + 1 for _, lb, rb in short)
    assert G.optimize(raw, "max-blocks").columns == G.optimize(raw, "min-longest").columns


def test_repeats_longer_than_any_piece(spark):
    r = random.Random(31)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    unit = some(300)
    first = unit + some(20) + unit + some(20)
    rows = [first, first[:500] + ("T" if first[500] != "T" else "A") + first[501:]]
    ranked = A.with_rank(A.cells_of(spark.createDataFrame(list(enumerate(rows)), "seq_id int, seq string"))).cache()
    got = {(x.col, x.seq_id): x.d for x in G.unique_prefixes(ranked, 16).collect()}
    for col in (0, 7, 150, 299, 310, 320, 400, 639):
        for j, row in enumerate(rows):
            at = lambda p: {i for u in rows for i in range(len(u)) if u.startswith(p, i)}
            assert got[col, j] == next((n for n in range(1, len(row) - col + 1) if at(row[col : col + n]) == {col}), None)
    assert got[0, 0] >= 180


@pytest.mark.parametrize("stretch", [3, 5])
def test_chains_over_many_stretches(spark, monkeypatch, stretch):
    r = random.Random(stretch)
    monkeypatch.setattr(G, "STRETCH", stretch)
    raw = {a: (None if r.random() < 0.2 and a else min(59, a + r.randint(0, 6))) for a in range(60)}
    most, _ = brute_optimum(raw, 60)
    seg = [tuple(x) for x in G.max_blocks(spark.createDataFrame(list(raw.items()), "lb bigint, rb bigint")).orderBy("block_idx").collect()]
    assert len(seg) == most and [x[0] for x in seg] == list(range(most)) and seg[-1][2] == 60
    assert all(a[2] == b[1] for a, b in zip(seg, seg[1:], strict=False))
    assert all(raw[lb] is not None and rb > raw[lb] for _, lb, rb in seg)


def test_graph_invariants(spark, tmp_path):
    rows = ["ACGTACGGTTAACCGT", "ACGTAC-GTTAACC-T", "ACCTACGGT-AACCGT", "AC-TACGGTTTACCGT"]
    cells = A.cells_of(spark.createDataFrame(list(enumerate(rows)), "seq_id int, seq string"))
    seg = spark.createDataFrame([(0, 0, 5), (1, 5, 10), (2, 10, 16)], "block_idx int, lb bigint, rb bigint")
    told = []
    index = build_index(cells, seg, progress=told.append)
    assert told == ["ranked", "seg", "block-rows", "nodes", "edges", "blocks", "paths", "sets", "seeds"]
    walk = {}
    for r in index["rows"].orderBy("seq_id", "block_idx").collect():
        walk[r.seq_id] = walk.get(r.seq_id, "") + r.label
    assert walk == {j: r.replace("-", "") for j, r in enumerate(rows)}
    per_block = index["paths"].join(index["nodes"], "node_idx").groupBy("block_idx").count().collect()
    assert all(r["count"] == len(rows) for r in per_block)
    assert index["edges"].count() == index["edges"].select("lhs_idx", "rhs_idx").distinct().count()
    text = "#" + "".join(r.text for r in index["lines"].orderBy("off").collect())
    assert all(text[r.off : r.off + len(r.text)] == r.text for r in index["lines"].collect())
    index.save(str(tmp_path / "index"))
    space = {r.table: r.bytes for r in Index.space(spark, str(tmp_path / "index")).collect()}
    assert {"nodes", "edges", "seg", "vectors"} <= set(space) and min(space.values()) > 0
    again = Index.load(spark, str(tmp_path / "index"))
    assert {(r.table, r.status) for r in compare_indices(index, again).collect()} == {(t, "SAME") for t in TABLES if "ranks" not in t and "symbols" not in t}
    few = build_index(cells, seg, skip_text=True, skip_support=True)
    few.save(str(tmp_path / "few"))
    few = Index.load(spark, str(tmp_path / "few"))
    assert "lines" not in few and {(r.table, r.status) for r in compare_indices(few, again).collect()} >= {("nodes", "SAME"), ("paths", "RIGHT"), ("lines", "RIGHT")}
    with pytest.raises(ValueError, match="skip_text"):
        few.find(spark.createDataFrame([("ACG",)], "pattern string"))
    save_gap_index(cells, str(tmp_path / "gaps"))
    assert all(r.different == 0 and r.same == 16 for r in compare_gap_indices(index["ranked"], load_gap_index(spark, str(tmp_path / "gaps"))).collect())
    asked = ["ACGTACGGT", "TTTT", "GTTAACCGT", "AACCT", "CGGTTT", "T", "ACGTACGGTTAACCGT", "GGTTAACC"]
    found = {r.pattern: r for r in again.find(spark.createDataFrame([(p,) for p in asked], "pattern string")).collect()}
    bare = [r.replace("-", "") for r in rows]
    for p in asked:
        hit = found[p]
        if hit.did_expand:
            at = [(j, k) for j, r in enumerate(bare) for k in range(len(r)) if r.startswith(p, k)]
            assert hit.matches == ",".join(map(str, sorted({j for j, _ in at}))) and hit.match_count == len({j for j, _ in at})
            if at:
                column = min([i for i, c in enumerate(rows[j]) if c != "-"][k] for j, k in at)
                lb = max(x for x in (0, 5, 10) if x <= column)
                assert (hit.block_aln_pos, hit.match_offset) == (lb, column - lb)
        else:
            assert hit.match_count == sum(r.text.startswith(p, k) for r in index["lines"].collect() for k in range(len(r.text)))
    assert any(found[p].did_expand and found[p].match_count for p in asked)
    # a pattern reads the folders of its own seeds
    first = Q.starts(spark.createDataFrame([("ACGTACGGT",)], "pattern string"), again["seeds"])
    scanned = int(re.search(r"PartitionFilters: \[.*?folder", first._jdf.queryExecution().toString()) is not None)
    folders = {f.rsplit("/", 2)[-2] for f in again["seeds"].inputFiles()}
    assert scanned and len(folders) > 2 * len(Q.SEEDS) and first.count() >= 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.txt").write_text(" ".join(asked[:3]))
    answer(pattern_stream(spark, str(tmp_path / "in")), again.find, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    assert {tuple(r[c] for c in found[asked[0]].asDict()) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(found[p]) for p in asked[:3]}
    assert B.stats(index["nodes"], index["edges"], index["ranked"]).count() == 1


def test_stored_suffix_order(spark, tmp_path):
    texts = spark.createDataFrame([(0, "banana"), (1, "an")], "text_id bigint, s string")
    save_suffix_order(suffix_order_of(texts), str(tmp_path / "order"))
    again = suffix_order_of(texts, str(tmp_path / "order"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, suffix_order_of(texts).collect()))
    with pytest.raises(ValueError, match="suffixes"):
        suffix_order_of(texts.limit(1), str(tmp_path / "order"))
    # an order of as many suffixes, but of other texts
    save_suffix_order(suffix_order_of(texts), str(tmp_path / "known"), texts)
    assert sorted(map(tuple, suffix_order_of(texts, str(tmp_path / "known")).collect())) == sorted(map(tuple, again.collect()))
    for other in ([(0, "banane"), (1, "an")], [(1, "banana"), (0, "an")], [(0, "banan"), (1, "aan")]):
        with pytest.raises(ValueError, match="other texts"):
            suffix_order_of(spark.createDataFrame(other, "text_id bigint, s string"), str(tmp_path / "known"))
    assert [r.idx for r in load_suffix_order(spark, str(tmp_path / "known"), 2, 6).collect()] == [2, 3, 4, 5]
    assert both_or_neither("a", "b") and not both_or_neither(None, None)
    with pytest.raises(ValueError, match="needs"):
        both_or_neither("a", None)


def test_index_from_stored_orders(spark, tmp_path):
    rows = ["ACGTACGGTTAACCGT", "ACGTAC-GTTAACC-T", "ACCTACGGT-AACCGT"]
    cells = A.cells_of(spark.createDataFrame(list(enumerate(rows)), "seq_id int, seq string"))
    seg = spark.createDataFrame([(0, 0, 5), (1, 5, 10), (2, 10, 16)], "block_idx int, lb bigint, rb bigint")
    lines = build_index(cells, seg, skip_support=True)["lines"].cache()
    for name, backwards in (("order", False), ("back", True)):
        texts = indexed_texts(lines, backwards)
        save_suffix_order(suffix_order_of(texts), str(tmp_path / name), texts)
    with pytest.raises(ValueError, match="needs"):
        build_index(cells, seg, order=str(tmp_path / "order"))
    with pytest.raises(ValueError, match="other texts"):
        build_index(cells, seg, skip_support=True, order=str(tmp_path / "back"), reverse_order=str(tmp_path / "order"))
    build_index(cells, seg, skip_support=True, order=str(tmp_path / "order"), reverse_order=str(tmp_path / "back")).save(str(tmp_path / "index"))
    index = Index.load(spark, str(tmp_path / "index"))
    parts = [r.text for r in index["lines"].collect()]
    asked = ["A", "ACG", "GGT", "CCGT#", "TTT", "ACGTACGGT"]
    patterns = spark.createDataFrame([(p,) for p in asked], "pattern string")
    want = {p: sum(t.startswith(p, k) for t in parts for k in range(len(t))) for p in asked}
    assert {r.pattern: r.n for r in index.count(patterns).collect()} == want
    assert {r.pattern: (r.rb - r.lb, r.co_rb - r.co_lb) for r in index.ranges(patterns).collect()} == {p: (n - 1, n - 1) for p, n in want.items() if n}
