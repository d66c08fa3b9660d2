"""Scalar, text, tool, source and stream operators."""

import gzip
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from colweave.operators import alignment as A
from colweave.operators import suffixes as S_
from colweave.operators import text as X
from colweave.operators import tools as T
from colweave.sources import binary as S
from colweave.sources.alignments import map_columns, read_list
from colweave.streaming.patterns import answer, pattern_stream


@pytest.mark.parametrize(("a", "b", "order"), [("AAAA", "AAAA", 0), ("AAAA", "AAA-A", 0), ("AAAA", "AAAA-", 0), ("AAAA", "AAAB", -1), ("AAAA", "AAA-B", -1), ("AAAA", "AAAB-", -1)])
def test_gap_insensitive(spark, a, b, order):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(A.gap_insensitive_order(F.col("a"), F.col("b")).alias("x"), A.gap_insensitive_order(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (order, -order)


@pytest.mark.parametrize("piece", [3, 64])
def test_suffixes(spark, piece):
    rows = [(0, "banana"), (1, "bandana"), (2, ""), (3, "banana"), (4, "ab" * 40 + "c" + "ab" * 40)]
    texts = spark.createDataFrame(rows, "text_id bigint, s string")
    got = S_.suffix_order(texts, piece).orderBy("idx").collect()
    want = sorted((s[p:], i, p) for i, s in rows for p in range(len(s)))
    assert [(r.text_id, r.pos) for r in got] == [w[1:] for w in want]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert [r.lcp for r in got] == [0, *(common(a[0], b[0]) for a, b in zip(want, want[1:], strict=False))]
    by = dict(rows)
    assert all(r.ch == (by[r.text_id][r.pos - 1] if r.pos else "$") for r in got)


def test_counts_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(S_, "BLOCK", 16)
    rows = [(0, "banana"), (1, "bandana"), (2, ""), (3, "xyzab" * 30)]
    texts = spark.createDataFrame(rows, "text_id bigint, s string")
    words = ["ana", "an", "x", "q", "xyzabxyzabxyzab", "abxyzabxyzabxyzabxyzabx", "yzabxyzabxyzabq"]
    asked = spark.createDataFrame([(w,) for w in words], "pattern string")
    count = lambda w: sum(s.startswith(w, p) for _, s in rows for p in range(len(s)))
    assert {r.pattern: r.n for r in X.pattern_counts(texts, asked).collect()} == {w: count(w) for w in words}
    ahead = sorted((s[p:], i, p) for i, s in rows for p in range(len(s)))
    back = sorted((s[::-1][p:], i, p) for i, s in rows for p in range(len(s)))
    span = lambda order, w: (min(k for k, x in enumerate(order) if x[0].startswith(w)), max(k for k, x in enumerate(order) if x[0].startswith(w)))
    got = {r.pattern: (r.lb, r.rb, r.co_lb, r.co_rb) for r in X.bidirectional_ranges(texts, asked).collect()}
    assert got == {w: (*span(ahead, w), *span(back, w[::-1])) for w in words if count(w)}
    assert X.suffixes(texts, 5).count() == sum(len(s) for _, s in rows)


def test_runs(spark):
    values = "aaabbbbbbbbbbac" + "c" * 30
    cells = spark.createDataFrame([(k, i, c) for k in (1, 2) for i, c in enumerate(values[k:])], "seq_id int, col int, ch string")
    got = sorted((r.seq_id, r.run, r.ch, r.n) for r in X.run_lengths(cells, "seq_id", "col", "ch", stretch=4).collect())
    want = [(k, n, c, len(list(g))) for k in (1, 2) for n, (c, g) in enumerate(itertools.groupby(values[k:]))]
    assert got == want


def test_ranges(spark):
    texts = spark.createDataFrame([(1, "0123456789"), (2, "abc"), (3, "xyz")], "key int, s string")
    cuts = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 8, 8), (2, 0, 9)], "key int, lb bigint, rb bigint")
    assert {r.key: r.kept for r in T.remove_ranges(texts, cuts).collect()} == {1: "016789", 2: "", 3: "xyz"}
    wide = spark.createDataFrame([(0, 3_000_000), (5, 9), (2_000_000, 2_500_000), (4_000_000, 4_000_001), (4_000_001, 4_200_000), (9, 9)], "lb bigint, rb bigint")
    assert sorted(map(tuple, T.merged_ranges(wide).collect())) == [(0, 3_000_000), (4_000_000, 4_200_000)]
    padded = T.padded_ranges(spark.createDataFrame([(0, 5), (0, 6), (2, 9)], "lb bigint, rb bigint"), 3)
    assert sorted(tuple(r) for r in padded.collect()) == [(3, 3), (5, 6)]


def test_summary(spark):
    h = spark.createDataFrame([(3, 2), (5, 1), (9, 1), (None, 4)], "len bigint, n bigint")
    assert tuple(T.length_summary(h).first()) == (3, 9, 5.0, 3)


def test_block_gzip(spark, tmp_path):
    data = bytes(range(33, 120)) * 3000
    packed, index = S.block_gzip(data)
    assert gzip.decompress(packed) == data
    (tmp_path / "x.gz").write_bytes(packed)
    (tmp_path / "x.gz.gzi").write_bytes(index)
    blocks = S.read_blocks(spark, str(tmp_path / "x.gz")).orderBy("block").collect()
    assert b"".join(r.data for r in blocks) == data
    entries = S.read_block_index(spark, str(tmp_path / "x.gz.gzi"))
    assert [(r.c_off, r.u_off) for r in entries.orderBy("block").collect()] == [(r.c_off, r.u_off) for r in blocks]
    assert [r.block for r in S.blocks_of_range(entries, 65_279, 65_281).orderBy("block").collect()] == [0, 1]
    assert all(r.agrees for r in S.same_layout(entries).collect())
    (tmp_path / "y.gz").write_bytes(packed[: -len(S.END_BLOCK)])
    with pytest.raises(Exception, match="no end block"):
        S.read_blocks(spark, str(tmp_path / "y.gz")).collect()


def test_block_gzip_ranges(spark, tmp_path):
    data = bytes(random.Random(1).randrange(33, 126) for _ in range(200_000))
    packed, index = S.block_gzip(data)
    path = str(tmp_path / "x.gz")
    (tmp_path / "x.gz").write_bytes(packed)
    (tmp_path / "x.gz.gzi").write_bytes(index)
    for lb, rb in ((0, 10), (65_270, 65_300), (10, 199_999), (150_000, 400_000), (5, 5)):
        rows = S.read_gzip_range(spark, path, lb, rb).orderBy("u_off").collect()
        assert b"".join(r.data for r in rows) == data[lb:rb]
        assert all(data[r.u_off : r.u_off + len(r.data)] == r.data for r in rows)
        back = S.read_gzip_range(spark, path, lb, rb, reverse=True).orderBy(F.desc("u_off")).collect()
        assert b"".join(r.data for r in back) == data[lb:rb][::-1]
    # any gzip members, without sizes in their headers
    (tmp_path / "plain.gz").write_bytes(gzip.compress(data[:150_000]) + gzip.compress(data[150_000:]) + S.END_BLOCK)
    assert b"".join(r.data for r in S.read_blocks(spark, str(tmp_path / "plain.gz")).orderBy("block").collect()) == data


def test_byte_ranges(spark, tmp_path):
    data = bytes(random.Random(2).randrange(256) for _ in range(100_000))
    (tmp_path / "x").write_bytes(data)
    cuts = [(10, 20), (15, 40_000), (40_000, 40_000), (65_000, 65_001), (99_999, 100_500)]
    kept = bytes(b for i, b in enumerate(data) if not any(lb <= i < rb for lb, rb in cuts))
    chunks = S.file_chunks(spark, str(tmp_path / "x"))
    assert b"".join(r.data for r in chunks.orderBy("chunk").collect()) == data
    out = S.remove_byte_ranges(chunks, spark.createDataFrame(cuts, "lb bigint, rb bigint"))
    assert b"".join(r.kept for r in out.orderBy("chunk").collect()) == kept
    (tmp_path / "r").write_text("3 5\n\n7 9\n")
    assert sorted(map(tuple, S.read_ranges(spark, str(tmp_path / "r")).collect())) == [(3, 5), (7, 9)]
    (tmp_path / "r").write_text("3 3\n")
    with pytest.raises(Exception, match="empty range"):
        S.read_ranges(spark, str(tmp_path / "r")).collect()


def test_numbers(spark):
    rows = [(k, v) for k, v in enumerate([0, 0, 3, 3, 9, 40, 40, 1000])]
    split = T.elias_split(spark.createDataFrame(rows, "pos bigint, v bigint"), "v", 3)
    marks = [r.mark for r in split.orderBy("pos").collect()]
    assert marks == [(v >> 3) + k for k, v in rows] and len(set(marks)) == len(marks)
    assert {r.pos: r.value for r in T.elias_join(split, 3).collect()} == dict(rows)
    got = spark.createDataFrame([(0,), (1,), (2,), (255,), (256,)], "v bigint").select(T.bits_needed(F.col("v")).alias("b"), T.round_up(F.col("v"), 63).alias("r")).collect()
    assert [(x.b, x.r) for x in got] == [(1, 0), (1, 63), (2, 63), (8, 315), (9, 315)]


def test_segmentation_files(spark, tmp_path):
    raw = spark.createDataFrame([(0, 4), (1, None), (2, 5)], "lb bigint, rb bigint")
    whole = lambda parts: b"".join(r.content for r in parts.orderBy("part").collect())
    content = whole(S.raw_segmentation_parts(raw))
    assert struct.unpack("<4Q", content) == (3, 5, S.NO_BOUND, 4)
    (tmp_path / "raw").write_bytes(content)
    assert sorted(map(tuple, S.read_raw_segmentation(spark, str(tmp_path / "raw")).collect())) == [(0, 4), (1, None), (2, 5)]
    seg = spark.createDataFrame([(0, 0, 5), (1, 5, 9)], "block_idx int, lb bigint, rb bigint")
    (tmp_path / "seg").write_bytes(whole(S.segmentation_parts(seg)))
    assert sorted(map(tuple, S.read_segmentation(spark, str(tmp_path / "seg")).collect())) == [(0, 0, 5), (1, 5, 9)]
    (tmp_path / "v").write_bytes(S.vector_header(640, 7) + b"\0" * 80)
    head = S.read_vector_headers(spark, str(tmp_path / "v")).first()
    assert (head.bits, head.width) == (640, 7)


def test_read_list(spark, tmp_path):
    for n, s in (("b", "AC-T"), ("a", "ACGT")):
        (tmp_path / n).write_text(s)
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("A--T")
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a").write_text("GGGG")
    (tmp_path / "list").write_text("".join(f"{tmp_path}/{n}\n" for n in ("b", "a", "c.gz", "y/a", "a")))
    rows = read_list(spark, str(tmp_path / "list"))
    assert sorted(map(tuple, rows.collect())) == [(0, "AC-T"), (1, "ACGT"), (2, "A--T"), (3, "GGGG"), (4, "ACGT")]
    for reverse in (False, True):
        cut = map_columns(rows, 3, lambda batches: batches, "seq_id int, lb int, chars string", reverse=reverse)
        assert sorted((r.seq_id, r.lb, r.chars) for r in cut.where("seq_id = 0").collect()) == [(0, 0, "-CA" if reverse else "AC-"), (0, 3, "T")]


def test_pattern_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("AC GT\nTT AC")
    q = answer(pattern_stream(spark, str(tmp_path / "in")), lambda p: p.withColumn("n", F.length("pattern")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r.pattern for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["AC", "GT", "TT"]
