"""What builds and streams report: observed while tables are written, and a stream that asks a stored index."""

import time

import pytest
from pyspark.sql import functions as F

from colweave.functions.scratch import measured, settle, summed
from colweave.operators import alignment as A
from colweave.plans.index import Index, build_measured
from colweave.streaming.patterns import PatternProgress, answer, pattern_stream

ROWS = ["ACGTACGGTTAACCGT", "ACGTAC-GTTAACC-T", "ACCTACGGT-AACCGT", "AC-TACGGTTTACCGT"]


def test_measured(spark):
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    spark.sparkContext.setJobGroup("plain", "")
    settle(rows, "rows")
    spark.sparkContext.setJobGroup("seen", "")
    with measured() as outer:
        a = settle(rows, "rows")
        with measured() as inner:
            settle(a.where("v = 0"), "few")
        settle(a.limit(0), "rows")
    assert jobs("seen") <= 3 * jobs("plain")
    spark.sparkContext.setJobGroup("after", "")
    settle(rows, "rows")
    assert [(w["name"], w["rows"]) for w in outer] == [("rows", 1000), ("few", 143), ("rows", 0)]
    assert inner == outer[1:2] and min(w["bytes"] for w in outer) > 0
    assert [(s["name"], s["rounds"], s["rows"]) for s in summed(outer)] == [("rows", 2, 1000), ("few", 1, 143)]


def test_stream_asks_a_stored_index(spark, tmp_path):
    cells = A.cells_of(spark.createDataFrame(list(enumerate(ROWS)), "seq_id int, seq string"))
    seg = spark.createDataFrame([(0, 0, 5), (1, 5, 10), (2, 10, 16)], "block_idx int, lb bigint, rb bigint")
    index, metrics = build_measured(cells, seg)
    told = {r.name: r for r in metrics.collect()}
    assert told["ranked"].rows == 64 and told["ranked"].rounds == 1 and told["ranked"].bytes > 0
    for name in ("nodes", "edges", "paths", "sets", "seeds", "lines"):
        if name in told:
            assert told[name].rows == index[name].count()
    index.save(str(tmp_path / "index"))
    stored = Index.load(spark, str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("ACGTACGGT TTTT\nGTTAACCGT TTTT")
    heard = PatternProgress()
    spark.streams.addListener(heard)
    try:
        q = answer(pattern_stream(spark, str(tmp_path / "in")), stored.find, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(300)
        for _ in range(100):
            if heard.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert q.exception() is None and heard.failed == []
    assert heard.batches == [(0, 4, 3)]
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = stored.find(spark.createDataFrame([(p,) for p in ("ACGTACGGT", "TTTT", "GTTAACCGT")], "pattern string"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_failed_batch_is_heard_of(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("ACGT")
    heard = PatternProgress()
    spark.streams.addListener(heard)

    def broken(_):
        raise ValueError("no index here")

    try:
        q = answer(pattern_stream(spark, str(tmp_path / "in")), broken, str(tmp_path / "out"), str(tmp_path / "ck"))
        with pytest.raises(Exception, match="no index here"):
            q.awaitTermination(120)
        for _ in range(100):
            if heard.failed:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert any("no index here" in f for f in heard.failed)
