"""Quality classifier: logistic regression on hashed word n-grams, fitted with FTRL updates.

Features of a text, hashed into 2**BITS coordinates: each token, each pair of neighbouring
tokens, and each triple of token shapes (lower, capitalised, upper, mixed, digits, the sign
itself, and whether a token repeats the one before).  A coordinate's value is its count over
the number of tokens, so a score is one sparse dot product, whatever the text's length.

The model is fitted in one task on a bounded sample of labelled rows (``TRAIN_ROWS``, by a
hash of the id); scoring reads each text once and shuffles nothing.

Defined results: null and wordless texts have no features and score by the intercept alone;
repeated rows score alike; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.labelled import labelled_sample
from colweave.llm.spans import DIGIT, SIGN, Tokens, mix, windows

BITS = 18
#: Most labelled rows that the model is fitted on, and passes over them.
TRAIN_ROWS, EPOCHS = 6000, 2
#: FTRL: learning rate, its offset, and the penalties' weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: All values are multiplied by this, so that steps on long texts aren't tiny.
SCALE = 8.0
#: Score from which a text is called good.
THRESHOLD = 0.3


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and text of every feature that ends in a window's own tokens."""
    same = np.zeros(len(t), bool)
    same[1:] = (t.doc[1:] == t.doc[:-1]) & (t.hash[1:] == t.hash[:-1])
    size = t.end - t.at
    shape = np.where(t.upper == 0, 1, np.where(t.upper == 1, np.where(t.first_upper, np.where(size == 1, 5, 2), 3), np.where(t.upper * 10 >= size * 6, 4, 3))).astype(np.uint64)
    shape[t.kind == DIGIT] = 6
    shape = np.where(t.kind == SIGN, t.hash | np.uint64(16), shape)
    shape = mix(shape * np.uint64(2) + same.astype(np.uint64))
    near = t.doc[1:] == t.doc[:-1]
    pair = mix(t.hash[1:] * np.uint64(3) + t.hash[:-1])[near]
    far = near[1:] & near[:-1]
    triple = mix(shape[2:] * np.uint64(9) + shape[1:-1] * np.uint64(5) + shape[:-2])[far]
    mask = np.uint64((1 << BITS) - 1)
    own = slice(t.again, None)
    ends = np.arange(len(t)) >= t.again
    pair, triple = pair[ends[1:][near]], triple[ends[2:][far]]
    at = np.concatenate([t.hash[own], pair, triple]) & mask
    return at.astype(np.int64), np.concatenate([t.doc[own], t.doc[1:][near & ends[1:]], t.doc[2:][far & ends[2:]]])


def dot(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Weights' mean over each text's features, times SCALE."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for t in windows(texts, overlap=2):
        at, doc = features(t)
        total += np.bincount(doc, weights[at], len(texts))
        count += np.bincount(t.doc[t.again :], minlength=len(texts))
    return SCALE * total / np.maximum(count, 1)


def fit(texts: list[str], y: list[int]) -> tuple[np.ndarray, float]:
    """Weights and intercept by follow-the-regularised-leader (proximal, one rate for each coordinate)."""
    n = 1 << BITS
    z, s = np.zeros(n + 1), np.zeros(n + 1)
    rows = []
    for text in texts:
        parts, size = [], 0
        for t in windows([text], overlap=2):
            parts.append(features(t)[0])
            size += len(t) - t.again
        at, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
        rows.append((np.append(at, n), np.append(SCALE * c / max(size, 1), 1.0)))

    def leader(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        l1 = np.where(at == n, 0.0, L1)
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(s[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x
            step = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA
            z[at] += g - step * w
            s[at] += g * g
    w = leader(np.arange(n + 1))
    return w[:n].astype(np.float32), float(w[n])


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fit on the bounded sample, in one task; the model (2**BITS weights) comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            w, b0 = fit([r[1] for r in rows], [r[2] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([b0])], ["w", "b"])

    sample = labelled_sample(docs, labels, label, learn, TRAIN_ROWS, id_col=id_col, text_col=text_col)
    got = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "w binary, b double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(got[0].w, np.float32), got[0].b


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(dot(b.column(1).to_pylist(), w) + b0, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Learn from labelled rows that aren't held out, score all: doc_id, held_out, score, predicted."""
    scored = score_quality(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
