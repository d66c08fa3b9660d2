"""What grows with the input is neither broadcast nor gone through anew for each row."""

from pyspark.sql import functions as F

from colweave.functions.scratch import measured
from colweave.operators import segmentation as G
from colweave.operators import suffixes as S
from colweave.operators import text as X
from colweave.operators import tree as R


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    return spark.range(40).select(F.col("id").alias("text_id"), F.concat(F.lit("old plate "), (F.col("id") % 3).cast("string")).alias("s"))


def test_suffixes_arent_broadcast(spark):
    t = texts(spark)
    assert "Broadcast" not in plan(X.bwt(S.suffix_order(t)).select("idx", "ch"))
    wanted = t.select("text_id", F.explode(F.sequence(F.lit(0), F.length("s") - 1)).alias("pos"))
    assert "Broadcast" not in plan(S.pieces(wanted, S.text_blocks(t, S.BLOCK), S.BLOCK, 0, S.PIECE))
    assert "Broadcast" not in plan(X.left_extensions(t, 3))


def test_places_in_texts_arent_broadcast(spark, monkeypatch):
    t = texts(spark)
    words = spark.createDataFrame([("plate",), ("old plate 1",), ("old plate 12345",)], "pattern string")
    want = {("plate", 40), ("old plate 1", 13), ("old plate 12345", 0)}
    assert set(map(tuple, X.pattern_counts(t, words).collect())) == want
    monkeypatch.setattr(X, "FEW", 0)
    assert "Broadcast" not in plan(X.word_counts(lambda size: S.text_blocks(t, size), words.select(F.col("pattern").alias("word"))))
    assert set(map(tuple, X.pattern_counts(t, words).collect())) == want


def test_blocks_of_long_texts_hold_the_next_one(spark):
    t = spark.createDataFrame([(1, "abcdefghij"), (2, "abcd"), (3, ""), (4, None), (5, "xyz")], "text_id int, s string")
    got = sorted(map(tuple, S.text_blocks(t, 4).select("text_id", "block", "text", "own").collect()))
    assert got == [(1, 0, "abcdefgh", 4), (1, 1, "efghij", 4), (1, 2, "ij", 2), (2, 0, "abcd", 4), (5, 0, "xyz", 3)]


def test_next_blocks_take_one_pass(spark):
    raw = spark.range(9000).select(F.col("id").alias("lb"), F.when(F.col("id") % 7 < 5, F.col("id") + 3 + F.col("id") * 31 % 17).alias("rb")).where("rb IS NULL OR rb < 9000")
    found = G.next_blocks(raw)
    assert "unboundedfollowing" not in plan(found).lower()
    blocks = sorted((r.lb, r.rb + 1) for r in raw.where("rb IS NOT NULL").collect())
    want, best = {}, None
    later = {}
    for lb, rb in reversed(blocks):
        best = min([(rb, -lb), *([best] if best else [])])
        later[lb] = best
    starts = [b[0] for b in blocks]
    from bisect import bisect_left

    for lb, rb in blocks:
        k = bisect_left(starts, rb)
        n = later[starts[k]] if k < len(starts) else None
        want[lb] = (rb, -n[1] if n else None, n[0] if n else None)
    assert {r.lb: (r.rb, r.next_lb, r.next_rb) for r in found.collect()} == want


def test_ranks_arent_broadcast(spark):
    around = spark.range(9).select(F.col("id").alias("idx"), F.lit(0).alias("lcp"), F.col("id").alias("lb"), (F.col("id") + 1).alias("nb"), F.lit(True).alias("first"))
    assert "Broadcast" not in plan(R.suffix_tree(around, around))


def test_runs_are_dealt_before_they_are_sorted(spark):
    cells = spark.range(30).select((F.col("id") % 3).alias("p"), F.floor(F.col("id") / 3).alias("c"), F.when(F.col("id") % 5 < 3, "x").otherwise("y").alias("v"))
    runs = X.run_lengths(cells, "p", "c", "v", stretch=4)
    lines = plan(runs).split("== Initial Plan ==")[-1].splitlines()
    assert not any(" Sort" in x for x in lines[[k for k, x in enumerate(lines) if "Exchange hashpartitioning(p" in x][-1] :])
    assert sum(r.n for r in runs.collect()) == 30


def test_words_and_places_of_one_seed_dont_meet_in_pairs(spark):
    head = "abcdefghijkl"
    t = spark.range(60).select(F.col("id").alias("text_id"), F.concat(F.lit(head), (F.col("id") % 30).cast("string"), F.lit("#")).alias("s"))
    words = spark.range(40).select(F.concat(F.lit(head), F.col("id").cast("string")).alias("pattern"))
    text = [r.s for r in t.collect()]
    assert {r.pattern: r.n for r in X.pattern_counts(t, words).collect()} == {w: sum(s.count(w) for s in text) for w in (r.pattern for r in words.collect())}
    assert "StartsWith" not in plan(X.word_counts(lambda size: S.text_blocks(t, size), words.select(F.col("pattern").alias("word"))))


def test_least_longest_block_takes_no_more_rounds_for_more_stretches(spark):
    rounds = []
    for n in (64, 192):  # 4 and 12 stretches
        raw = spark.range(n).select(F.col("id").alias("lb"), F.least(F.col("id") + 1 + F.col("id") % 3, F.lit(n - 1)).alias("rb"))
        with measured() as written:
            assert G.min_longest_blocks(raw, stretch=16).agg(F.sum(F.col("rb") - F.col("lb"))).first()[0] == n
        rounds.append(sum(w["name"] == "states" for w in written))
    assert rounds[0] == rounds[1]
