"""Row sets as bitmaps, and pattern location with many rows through a node."""

import random

from pyspark.sql import functions as F

from colweave.functions import rowsets as R
from colweave.operators import find as Q


def _sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, set()).update(64 * R.WORDS * r.bucket + 64 * w + k for w, x in enumerate(r.bits) for k in range(64) if x >> k & 1)
    return out


def test_sets_against_python(spark):
    r = random.Random(1)
    want = {k: {r.choice([0, 63, 64, 127, 32767, 32768, 65535, 100_000, r.randint(0, 200_000)]) for _ in range(r.randint(1, 60))} for k in range(12)}
    pairs = spark.createDataFrame([(k, i) for k, ids in want.items() for i in [*ids, next(iter(ids))]], "k int, seq_id int")
    sets = R.row_sets(pairs, ["k"]).cache()
    assert _sets(sets) == want
    assert {(x.k, x.seq_id) for x in R.members(sets, ["k"]).collect()} == {(k, i) for k, ids in want.items() for i in ids}
    halved = sets.withColumn("k", F.col("k") % 4)
    assert _sets(R.united(halved, ["k"])) == {k: want[k] | want[k + 4] | want[k + 8] for k in range(4)}
    three = {k: want[k] & want[k + 4] & want[k + 8] for k in range(4)}
    assert _sets(R.common(halved, ["k"], 3)) == {k: v for k, v in three.items() if v}
    sizes = sets.groupBy("k").agg(F.sum(R.size_of(F.col("bits"))).alias("n")).collect()
    assert {x.k: x.n for x in sizes} == {k: len(v) for k, v in want.items()}
    listed = sets.select("k", R.listed(F.col("bits"), F.col("bucket")).alias("ids")).collect()
    assert all(x.ids == sorted(x.ids) and set(x.ids) <= want[x.k] for x in listed)
    other = sets.withColumn("k", (F.col("k") + 1) % 12).withColumnsRenamed({"bits": "more"})
    met = sets.join(other, ["k", "bucket"]).withColumn("bits", R.both(F.col("bits"), F.col("more"))).where(R.any_bit(F.col("bits")))
    assert _sets(met) == {k: v for k in range(12) if (v := want[k] & want[(k - 1) % 12])}


def test_many_rows_through_a_node(spark):
    """100 000 rows share their first node and part at the second; the walk carries buckets of bits, no ids."""
    n = 100_000
    nodes = spark.createDataFrame([(0, 0, "ACG"), (1, 1, "TTA"), (2, 1, "TTC"), (3, 2, "G")], "node_idx bigint, block_idx int, label string")
    edges = spark.createDataFrame([(0, 1, "TTA"), (0, 2, "TTC"), (1, 3, "G"), (2, 3, "G")], "lhs_idx bigint, rhs_idx bigint, rhs_label string")
    ids = spark.range(n).select(F.col("id").cast("int").alias("seq_id"))
    paths = ids.select(F.lit(0).cast("bigint").alias("node_idx"), "seq_id").unionByName(ids.select(F.when(F.col("seq_id") % 3 == 0, 1).otherwise(2).cast("bigint").alias("node_idx"), "seq_id")).unionByName(ids.select(F.lit(3).cast("bigint").alias("node_idx"), "seq_id"))
    asked = spark.createDataFrame([("CGTTAG",), ("ACGTT",), ("TTAGG",), ("G",)], "pattern string")
    got = Q.locate(asked, nodes, edges, paths)
    assert got.columns == ["pattern", "node_idx", "block_idx", "offset", "bucket", "bits"]
    rows = got.collect()
    assert max(len(r.bits) for r in rows) <= R.WORDS
    sizes = {}
    for r in rows:
        key = (r.pattern, r.node_idx, r.offset)
        sizes[key] = sizes.get(key, 0) + sum(bin(x & (1 << 64) - 1).count("1") for x in r.bits)
    third = -(-n // 3)
    assert sizes == {("CGTTAG", 0, 1): third, ("ACGTT", 0, 0): n, ("G", 0, 2): n, ("G", 3, 0): n}
