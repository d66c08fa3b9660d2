"""Centroid clustering of integer vectors by partial-distance search.

Vectors are whole numbers, so all distances, sums and centroids are exact.  A distance is
accumulated over a few components at a time, those of high variance first; a centroid is
abandoned as soon as its partial distance is strictly above the row's best one, and those that
are never above it finish all components, so that ties still go to the smaller number.  Each
row starts from the centroid that is nearest over the first components, which makes its best
distance small from the start.

A round is one job: tasks add up their rows by centroid and emit one row for each centroid and
component, whatever the number of rows; only the centroids themselves are on the driver.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part; a null id takes part but starts no centroid; repeated rows count each
time; fewer rows than centroids give as many centroids as rows; an empty table gives no row.
no ids at all give no centroids and no rows.  Distances and inertias beyond a long are given as
the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.store import settle

#: Components that are added before centroids are abandoned again; rows that are looked at together.
STEP, ROWS = 8, 4096
#: Magnitude up to which squared distances of up to 64 components fit a long.
REACH = 1 << 27
_MOST = (1 << 63) - 1


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number among equals."""
    if len(x) and max(abs(x.astype(np.float64)).max(), abs(centroids.astype(np.float64)).max()) > REACH:
        x, centroids = x.astype(object), centroids.astype(object)
    square = lambda d: (d * d).sum(axis=-1)
    part = np.stack([square(x[:, :step] - c[:step]) for c in centroids], axis=1)
    guess = part.argmin(axis=1)
    label, best = guess.copy(), square(x - centroids[guess])
    for k, c in enumerate(centroids):
        rows = np.nonzero((guess != k) & (part[:, k] <= best))[0]
        far = part[rows, k]
        for a in range(step, x.shape[1], step):
            far = far + square(x[rows, a : a + step] - c[a : a + step])
            alive = far <= best[rows]
            rows, far = rows[alive], far[alive]
        nearer = (far < best[rows]) | ((far == best[rows]) & (k < label[rows]))
        label[rows[nearer]], best[rows[nearer]] = k, far[nearer]
    return label.astype(np.int32), best


def _blocks(b: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for a in range(0, b.num_rows, ROWS):
        part = b.slice(a, ROWS)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spread(kept: DataFrame, dims: int) -> np.ndarray:
    """Components by falling variance, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            for _, x in _blocks(b, 0, dims):
                y = x.astype(np.float64)
                n, one, two = n + len(y), one + y.sum(axis=0), two + (y * y).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, float(n))), pa.array(one), pa.array(two)], ["dim", "n", "one", "two"])

    # a row for each component
    rows = kept.select("v").mapInArrow(run, "dim int, n double, one double, two double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    variance = np.zeros(dims)
    for r in rows:
        variance[r.dim] = r.two / r.n - (r.one / r.n) ** 2
    return np.argsort(-variance, kind="stable")


def _moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its rows' mean; those without rows stay."""
    count, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sizes = np.zeros((count, dims), object), np.zeros(count, np.int64)
        for b in batches:
            for _, x in _blocks(b, 0, dims):
                label, _far = nearest(x[:, order], centroids[:, order])
                big = len(x) and abs(x.astype(np.float64)).max() > REACH
                for k in np.unique(label):
                    own = x[label == k]
                    totals[k] += (own.astype(object) if big else own).sum(axis=0)
                    sizes[k] += len(own)
        used = np.nonzero(sizes)[0]
        if len(used):
            each = [pa.array(np.repeat(used.astype(np.int32), dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))), pa.array([Decimal(int(t)) for t in totals[used].reshape(-1)], pa.decimal128(38, 0)), pa.array(np.repeat(sizes[used], dims))]
            yield pa.RecordBatch.from_arrays(each, ["cluster", "dim", "total", "n"])

    sums = kept.select("v").mapInArrow(run, "cluster int, dim int, total decimal(38,0), n bigint").groupBy("cluster", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, *, count: int = 8, rounds: int = 10, scale: float = 1024.0, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector of ``dims`` components.

    ``count`` centroids start as the vectors of the smallest sha256 of ``seed:id`` (equal ids:
    the smaller vector); each of ``rounds`` rounds assigns all vectors and moves the centroids.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = settle(vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")), "vectors")
    first = kept.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(count).collect()
    schema = "vec_id bigint, cluster int, distance bigint"
    if not first:
        return kept.where("vec_id IS NOT NULL").select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    centroids, order = np.array([r.v for r in first], np.int64), _spread(kept, dims)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _blocks(b, 1, dims):
                label, far = nearest(x[:, order], centroids[:, order])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array([min(int(d), _MOST) for d in far], pa.int64())], ["vec_id", "cluster", "distance"])

    placed = settle(kept.select("vec_id", "v").mapInArrow(assign, schema), "placed")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(k, min(s, _MOST), min(sum(sums.values()), _MOST), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
