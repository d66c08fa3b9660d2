"""Exact top-k inner-product search over a pivot-distance index.

Vectors are keyed by their nearest pivot and by their distance to it (rings of equal width
around the pivot).  With r the distance of a row from pivot p, the triangle inequality gives
|q - x| >= | |q - p| - r |, and since q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a ring whose
largest norm is M and whose distances lie in [r0, r1] can't hold a score over

    (|q|^2 + M^2 - gap^2) / 2,     gap = max(0, r0 - |q - p|, |q - p| - r1).

Each query orders all rings by that bound.  It reads its best ring first, which gives a k-th
score, then the rings around whose bound still reaches that score, and no other.  Rings are
dealt in blocks of rows and of queries, so that neither a popular ring nor a large query set
meets in one task.  The pivots come from a bounded sample (``SAMPLE`` rows by hash order);
every row is indexed and the result is exact whatever the pivots are.

Defined results: null ids, and vectors that are null, empty or hold null or non-finite
components take no part; only vectors of equal length are compared; repeated query rows
count once; rows with the query's own id are no candidates; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm.store import settle, shuffle_width

#: Rows from which pivots are chosen; pivots; rings around each.
SAMPLE, PIVOTS, RINGS = 2048, 16, 32
#: Rows and queries that meet in one block; probes in one batch.
ROWS_IN_BLOCK, QUERIES_IN_BLOCK, PROBES = 256, 2048, 4096

_KEY = ["dim", "pivot", "ring", "block", "ask"]


def _vectors(col) -> np.ndarray:
    return np.array(col.to_pylist(), np.int64)


def _choose(sample: np.ndarray) -> np.ndarray:
    """Farthest-first pivots."""
    x = sample.astype(np.float64)
    chosen = [0]
    gap = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < PIVOTS and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v.astype(np.float64) - p, axis=1) for p in pivots], axis=1)


def _dealt(ids: np.ndarray, asks: int) -> np.ndarray:
    """Block of each query, whatever its id is a multiple of."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(asks)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    reach = np.sqrt((q.astype(np.float64) ** 2).sum(1).max() * (x.astype(np.float64) ** 2).sum(1).max())
    if reach < 2**52:  # every partial sum is an integer that a double holds
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.array([[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, w, strict=True)))) for w in x] for u in q], np.int64)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the rows that take part."""
    x = F.col(vector_col)
    whole = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _indexed(base: DataFrame, pivots: dict[int, np.ndarray], width: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims = np.array([len(x) for x in b.column(1)])
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                v = _vectors(own.column(1))
                far = _to_pivots(v, pivots.get(int(dim), np.zeros((1, dim))))
                at = far.argmin(axis=1)
                dist = far[np.arange(len(v)), at]
                ring = np.minimum(dist // width.get(int(dim), 1.0), RINGS - 1).astype(np.int32)
                norm = np.linalg.norm(v.astype(np.float64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), dim, np.int32)), pa.array(at.astype(np.int32)), pa.array(ring), pa.array(dist), pa.array(norm), own.column(0), own.column(1)], ["dim", "pivot", "ring", "dist", "norm", "vec_id", "v"])

    return base.mapInArrow(run, "dim int, pivot int, ring int, dist double, norm double, vec_id long, v array<bigint>")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query's inner products."""
    spark = vectors.sparkSession
    queries = integer_vectors(vectors.where(is_query), id_col, vector_col, scale).distinct()
    base = integer_vectors(vectors, id_col, vector_col, scale)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots, width = {}, {}
    for dim in {len(r.v) for r in sample}:
        own = np.array([r.v for r in sample if len(r.v) == dim], np.int64)
        pivots[dim] = _choose(own)
        width[dim] = max(1.0, float(_to_pivots(own, pivots[dim]).min(axis=1).max()) / (RINGS - 1))
    index = settle(_indexed(base, pivots, width), "index")
    # one row for each ring in use: pivots x rings for each vector length
    rings = index.groupBy("dim", "pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm").alias("norm")).toPandas()
    rings["blocks"] = -(-rings["n"] // ROWS_IN_BLOCK)
    asks = max(1, -(-queries.count() // QUERIES_IN_BLOCK))
    block_of = spark.createDataFrame(rings[["dim", "pivot", "ring", "blocks"]].astype("int32"), "dim int, pivot int, ring int, blocks int")
    placed = index.join(F.broadcast(block_of), ["dim", "pivot", "ring"]).select("dim", "pivot", "ring", F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").cast("int").alias("block"), "vec_id", "v")

    def plan(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = np.array([len(x) for x in b.column(1)], np.int64)
                for dim in np.unique(sizes).tolist():
                    own = rings[rings["dim"] == dim]
                    if not len(own):
                        continue
                    part = b.filter(pa.array(sizes == dim))
                    x, ids = _vectors(part.column(1)), part.column(0).to_numpy()
                    floor = part.column(2).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    far = _to_pivots(x, pivots.get(dim, np.zeros((1, dim))))[:, own["pivot"].to_numpy()]
                    gap = np.maximum(0, np.maximum(own["near"].to_numpy() - far, far - own["far"].to_numpy()))
                    norms = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + own["norm"].to_numpy()[None, :] ** 2
                    bound = (norms - gap**2) / 2 + 1 + 1e-9 * norms  # rounding
                    ready = own["n"].to_numpy() > k
                    best = np.where(ready, bound, -np.inf).argmax(axis=1) if ready.any() else bound.argmax(axis=1)
                    mine = np.zeros(bound.shape, bool)
                    mine[np.arange(len(x)), best] = True
                    q, ring = np.nonzero(mine if first else (bound >= floor[:, None]) & ~mine)
                    n = own["blocks"].to_numpy()[ring].astype(np.int64)
                    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    q, ring = np.repeat(q, n), np.repeat(ring, n)
                    for at in range(0, len(q), PROBES):
                        z = slice(at, at + PROBES)
                        named = [np.full(len(q[z]), dim), own["pivot"].to_numpy()[ring[z]], own["ring"].to_numpy()[ring[z]], block[z], _dealt(ids[q[z]], asks)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in named), pa.array(ids[q[z]]), part.column(1).take(pa.array(q[z]))], [*_KEY, "query_id", "q"])

        return run

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        left = left.sort_by("vec_id")
        ids, x = left["vec_id"].to_numpy(), _vectors(left["v"])
        asked, q = right["query_id"].to_numpy(), _vectors(right["q"])
        s = _scores(q, x)
        s_of = np.where(asked[:, None] == ids[None, :], np.iinfo(np.int64).min, s)
        best = np.argsort(-s_of.astype(np.float64) if abs(s).max() < 2**52 else -(s_of // 2), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(q)), best.shape[1])
        cols = best.reshape(-1)
        kept = asked[rows] != ids[cols]
        return pa.table([asked[rows][kept], ids[cols][kept], s[rows, cols][kept]], names)

    def scan(floors: DataFrame, first: bool) -> DataFrame:
        # few rows, each of which asks many rings: dealt anew, so that all tasks plan
        probes = floors.repartition(shuffle_width(spark)).mapInArrow(plan(first), "dim int, pivot int, ring int, block int, ask int, query_id long, q array<bigint>")
        if asks > 1:
            # a block goes to those blocks of queries that ask for it, and to no others
            probes = settle(probes, "probes")
            asked = probes.select(*_KEY).distinct().select(*_KEY[:-1], F.col("ask").alias("by")).withColumnRenamed("by", "ask")
            dealt = placed.join(asked, _KEY[:-1])
        else:
            dealt = placed.withColumn("ask", F.lit(0))
        return dealt.groupBy(*_KEY).cogroup(probes.groupBy(*_KEY)).applyInArrow(meet, "query_id long, vec_id long, score long")

    start = settle(scan(queries.withColumn("floor", F.lit(None).cast("long")), True), "first-ring")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = start.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = scan(queries.join(kth, "vec_id", "left").select("vec_id", "v", "floor"), False)
    found = start.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
