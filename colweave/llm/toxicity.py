"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting (on a bounded sample of labelled rows): occurrences of each token, and of the first
``STEM`` bytes of longer ones, are counted in toxic and in clean documents; their log-odds
ratio under an informative Dirichlet prior (the pooled frequencies) is kept, shrunk by its
z-score, for the ``ENTRIES`` most telling tokens.  Every other token scores -DRIFT, so a
walk over clean text falls.  Each labelled row is scored once by a model whose counts it had no
part in (``FOLDS`` of them); these scores calibrate what follows.

Scoring: one linear scan finds all maximal segments of positive score (each kept segment
beats all of its own ends and every segment that overlaps it).  A segment's score S has the
extreme-value tail P(max > S) = 1 - exp(-K n exp(-lambda S)) in a clean text of n tokens,
where lambda solves E[exp(lambda s)] = 1 over clean tokens, and K is the likeliest value for
the best segments of the sample's clean rows.  Segments with an expected number of chance
occurrences under ``CHANCE`` are significant; a document's evidence is the sum of their
-log(K n) + lambda S, and one logistic curve turns evidence into a probability.

Defined results: null and wordless texts have no segments and score by the curve's
intercept; repeated rows score alike; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.labelled import labelled_sample
from colweave.llm.spans import LETTER, Tokens, mix, windows
from colweave.llm.store import settle

#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
#: Parts of the sample, each scored by a model of the others.
FOLDS = 5
#: Most tokens and stems with a score of their own, and fewest documents that hold one.
ENTRIES, LEAST = 50_000, 2
#: Bytes of a stem; weight of the prior in tokens; step of a token that tells nothing; full weight from this z-score on.
STEM, PRIOR, DRIFT, FULL_Z = 5, 20_000.0, 0.5, 4.0
#: A token of a smaller z-score tells nothing.
LEAST_Z = 2.0
#: The expected chance occurrences that a significant segment stays under.
CHANCE = 0.05
#: Score from which a text is called toxic.
THRESHOLD = 0.3

_STEM_SALT = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    odds: np.ndarray
    sieve: np.ndarray  # by the lowest 20 bits: whether any key has them
    lam: float
    k: float = 0.1
    slope: float = 1.0
    intercept: float = 0.0


def _hashes(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes; which tokens have a stem; the stems' hashes."""
    long = (t.kind == LETTER) & (t.end - t.at > STEM)
    stem = np.zeros(len(t), np.uint64)
    own = np.where(long, t.at + STEM, t.end)
    stem[:] = mix(t.hash_of(own) ^ _STEM_SALT)
    return t.hash, long, stem


def _look_up(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that have a score, and the scores."""
    at = np.nonzero(m.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])[0]
    k = np.searchsorted(m.keys, h[at])
    hit = np.zeros(len(at), bool)
    inside = k < len(m.keys)
    hit[inside] = m.keys[k[inside]] == h[at][inside]
    return at[hit], m.odds[k[hit]]


def token_scores(m: Model, t: Tokens) -> np.ndarray:
    """Score of each token: its own, else its stem's, else -DRIFT."""
    out = np.full(len(t), -DRIFT)
    own, long, stem = _hashes(t)
    if len(m.keys):
        at = np.nonzero(long)[0]
        k, v = _look_up(m, stem[at])
        out[at[k]] = v - DRIFT
        k, v = _look_up(m, own)
        out[k] = v - DRIFT
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Only positive tokens open or close one, so the scan steps over them and takes what lies
    between from running sums.  ``left`` of a candidate is the sum before it, ``right`` the
    sum up to its end; each remembers the last candidate whose left sum is smaller.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.nonzero(scores > 0)[0].tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((start, end, left, right, j))
    return [(a, b, r - x) for a, b, x, r, _ in found]


def all_segments(m: Model, texts: list[str | None]) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
    """Of each text: its maximal segments by token position (start, end, score), and its number of tokens."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for t in windows(texts):
        s = token_scores(m, t)
        cuts = np.nonzero(np.diff(t.doc))[0] + 1
        for own, at in zip(np.split(s, cuts), [0, *cuts], strict=True):
            if len(own):
                parts[t.doc[at]].append(own)
    sizes = np.array([sum(map(len, p)) for p in parts], np.int64)
    return [segments(np.concatenate(p)) if any((x > 0).any() for x in p) else [] for p in parts], sizes


def evidence_of(score: float, lam: float, k: float, n: int) -> float:
    """-log of the expected chance occurrences of a segment of that score in n clean tokens; 0 if they aren't under CHANCE."""
    e = lam * score - float(np.log(k * n))
    return e if e > -np.log(CHANCE) else 0.0


def passages(m: Model, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
    """Of each text: its significant segments by token position (start, end, evidence)."""
    found, sizes = all_segments(m, texts)
    return [[(a, b, e) for a, b, s in own if (e := evidence_of(s, m.lam, m.k, int(n))) > 0] for own, n in zip(found, sizes, strict=True)]


def _evidence(found: list[list[tuple[int, int, float]]]) -> np.ndarray:
    return np.log1p(np.array([sum(x[2] for x in f) for f in found]))


def tail_constant(best: np.ndarray, sizes: np.ndarray, lam: np.ndarray) -> float:
    """The likeliest K for the best scores of clean texts (0: no segment), each under its model's lambda."""
    mass = float((sizes * np.exp(-lam * best)).sum())
    seen = int((best > 0).sum())
    return seen / mass if seen and mass > 0 else 0.1


def _counts(sample: DataFrame) -> DataFrame:
    """key, part, toxic, clean (occurrences), docs: of tokens and stems by part of the sample, added up in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y, parts = b.column(0).to_pylist(), *(np.array(b.column(k).to_pylist(), np.int64) for k in (1, 2))
            for t in windows(texts):
                own, long, stem = _hashes(t)
                key = np.concatenate([own, stem[long]])
                doc = np.concatenate([t.doc, t.doc[long]])
                order = np.lexsort((doc, parts[doc], key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (parts[doc[1:]] != parts[doc[:-1]])
                first_in_doc = new.copy()
                first_in_doc[1:] |= doc[1:] != doc[:-1]
                at = np.nonzero(new)[0]
                if not len(at):
                    continue
                toxic = np.add.reduceat((y[doc] > 0).astype(np.int64), at)
                every = np.diff(np.append(at, len(key)))
                docs = np.add.reduceat(first_in_doc.astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(parts[doc[at]].astype(np.int32)), pa.array(toxic), pa.array(every - toxic), pa.array(docs)], ["key", "part", "toxic", "clean", "docs"])

    each = sample.select("text", "y", "part").mapInArrow(run, "key long, part int, toxic long, clean long, docs long")
    return each.groupBy("key", "part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("docs").alias("docs"))


def _root(mass: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum(mass * exp(x * score)) = 1, by bisection."""
    if not (score > 0).any():
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float((mass * np.exp(np.minimum(x * score, 500))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept, lightly penalised, by Newton steps."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.05 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(max(w[0], 0.0)), float(w[1])


def model_of(key: np.ndarray, odds: np.ndarray, z: np.ndarray, mass: np.ndarray) -> Model:
    """A model from tokens' hashes, log-odds ratios, z-scores, and shares of all clean tokens."""
    order = np.argsort(key)
    key, odds, z, mass = key[order], odds[order], z[order], mass[order]
    scored = odds * np.minimum(1.0, np.abs(z) / FULL_Z)
    scored = np.where(scored > 0, scored, np.maximum(scored, -1.0))
    sieve = np.zeros(1 << 20, bool)
    sieve[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True
    # tokens and stems both have mass here; the rest of the walk is drift
    other = max(0.0, 1.0 - mass.sum())
    lam = _root(np.append(mass, other + 1e-12) / max(1.0, mass.sum()), np.append(scored - DRIFT, -DRIFT))
    return Model(key, scored, sieve, lam)


def _fitted(counts: DataFrame) -> Model | None:
    """A model from counts (key, toxic, clean, docs, a key's rows to be added up); the ENTRIES most telling keys come to the driver."""
    counts = counts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("docs").alias("docs"))
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not totals.t or not totals.c:
        return None
    t, c = float(totals.t), float(totals.c)
    pooled = F.lit(PRIOR / (t + c)) * (F.col("toxic") + F.col("clean"))
    rest = lambda x, n: F.lit(n + PRIOR) - F.col(x) - pooled
    odds = F.log((F.col("toxic") + pooled) / rest("toxic", t)) - F.log((F.col("clean") + pooled) / rest("clean", c))
    z = odds / F.sqrt(1 / (F.col("toxic") + pooled) + 1 / (F.col("clean") + pooled))
    told = counts.where(F.col("docs") >= LEAST).select("key", odds.alias("odds"), z.alias("z"), (F.col("clean") / c).alias("mass")).where(F.abs("z") >= LEAST_Z)
    best = told.orderBy(F.desc(F.abs("z")), "key").limit(ENTRIES).toPandas()
    return model_of(best["key"].to_numpy(np.int64).view(np.uint64), *(best[x].to_numpy(np.float64) for x in ("odds", "z", "mass")))


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on the bounded sample; the tables of scores (ENTRIES rows) and one row a labelled row come to the driver."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    sample = settle(labelled_sample(docs, labels, label, learn, TRAIN_ROWS, id_col=id_col, text_col=text_col).withColumn("part", part), "labelled")
    counts = settle(_counts(sample), "token-odds")
    model = _fitted(counts)
    if model is None:
        return None
    others = [_fitted(counts.where(F.col("part") != k)) for k in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, parts = b.column(0).to_pylist(), b.column(2).to_pylist()
            scores: list[list[float]] = [[] for _ in texts]
            sizes = np.zeros(len(texts), np.int64)
            for k in set(parts):
                own = [i for i, p in enumerate(parts) if p == k]
                if shared.value[k] is not None:
                    found, n = all_segments(shared.value[k], [texts[i] for i in own])
                    sizes[own] = n
                    for i, f in zip(own, found, strict=True):
                        scores[i] = [x[2] for x in f]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.list_(pa.float64())), pa.array(sizes), b.column(1), b.column(2)], ["scores", "n", "y", "part"])

    rows = sample.select("text", "y", "part").mapInArrow(run, "scores array<double>, n bigint, y int, part int").toPandas()
    lam = np.array([others[k].lam if others[k] else 1.0 for k in rows["part"]])
    y, n = rows["y"].to_numpy() > 0, rows["n"].to_numpy(np.int64)
    best = np.array([max(s, default=0.0) for s in rows["scores"]])
    model.k = tail_constant(best[~y], n[~y], lam[~y])
    x = np.log1p(np.array([sum(evidence_of(v, a, model.k, int(m)) for v in s) for s, a, m in zip(rows["scores"], lam, n, strict=True)]))
    model.slope, model.intercept = _curve(x, y.astype(np.float64))
    return model


def score_toxicity(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted, passages (start, end by token, evidence) that are significant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES scores
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            found = passages(m, texts) if m else [[] for _ in texts]
            p = 1 / (1 + np.exp(-np.clip(m.slope * _evidence(found) + m.intercept, -30, 30))) if m else np.zeros(len(texts))
            spans = pa.array([[{"start": a, "end": e, "evidence": v} for a, e, v in f] for f in found], passage)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), spans], [id_col, "score", "predicted", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, passages array<struct<start: bigint, end: bigint, evidence: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Learn from labelled rows that aren't held out, score all: doc_id, held_out, score, predicted, passages."""
    scored = score_toxicity(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages")
