"""Top-k search over several blocks of queries: only what is asked for is copied."""

import numpy as np
from pyspark.sql import functions as F

from colweave.llm import topk


def test_only_asked_blocks_are_copied(spark, monkeypatch):
    r = np.random.default_rng(5)
    centers = r.normal(size=(8, 12)) * 3
    rows = [(i, [float(x) for x in centers[i % 8] + r.normal(size=12) * 0.05], "r", 0.5) for i in range(400)]
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 5)
    monkeypatch.setattr(topk, "ROWS_IN_BLOCK", 16)
    kept = {}
    plain = topk.settle
    monkeypatch.setattr(topk, "settle", lambda df, name: kept.setdefault(name, []).append(plain(df, name)) or kept[name][-1])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string, score double")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
    v = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x, *_ in rows]
    for q, x in v[::10]:
        best = sorted((-int(x @ y), i) for i, y in v if i != q)[:5]
        assert [(z.vec_id, z.score) for z in sorted((z for z in got if z.query_id == q), key=lambda z: z.rank)] == [(i, -s) for s, i in best]
    first, rest = kept["probes"]
    asked = first.unionByName(rest).select(*topk._KEY).distinct().collect()
    assert {a.ask for a in asked} == set(range(8))
    blocks = kept["index"][0].groupBy("dim", "pivot", "ring").count().select(F.sum(F.ceil(F.col("count") / 16))).first()[0]
    # every block for every block of queries would be 8 copies of each row
    assert len(asked) < 8 * blocks / 2
