"""Repeated passages across documents by relative Lempel-Ziv factors.

The reference of a document is every document of a smaller id.  It is indexed in *blocks*: each
``window`` consecutive words are filed under their anchor, the run of ``window // 2`` words in
them with the least hash, and neighbouring windows of one anchor make a block.  Windows of equal
words choose the same anchor, so a window is in the reference exactly if some block under its
anchor, of an earlier document, holds it; no other block has to be read.

Documents are then factored against the blocks:

1. A block whose anchor other documents hold as well, with the same words all through, is matched
   as a whole by the first document that has it.
2. At the boundaries of such factors blocks differ in part.  There, each window of the first
   document of every different block is looked up by itself, again for the first document that
   has it.
3. What matches a document at each place is merged greedily from left to right: a factor goes as
   far as places agree on their source, and the next one takes the match that reaches farthest.

Every step groups by hashes with partial sums (minima over documents), so that a passage of any
number of copies costs its copies, never its pairs.  Blocks and windows are told apart by 128
bits.  Long texts are hashed a slice at a time.

Defined results: a null text has no words; a null id has no smaller and no larger one, so such a
row neither loses words nor takes any from others; rows of one id are judged alike and never by
each other; repeated rows each give their row; fewer words than a window: nothing is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.spans import mix
from colweave.llm.store import settle

#: Bytes of a text that are split into words together; windows that are hashed together; words whose hashes a worker keeps.
BYTES, SLICE, WORDS = 1 << 20, 1 << 17, 400_000
#: Rows of one emitted batch.
BATCH = 1 << 16

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}
_WHITE = re.compile(rb"[\x20\t-\r]")


class _Hashes(dict):
    """Hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists from slices of bounded size."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        cut = _WHITE.search(data, at + BYTES) if at + BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)) for words in word_slices(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            factors = np.full(max(n, 4096), x, np.uint64)
            factors[0] = 1
            out.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[base] = out
    return _POWERS[base]


class _Runs:
    """Hashes of runs of words, from one running sum."""

    def __init__(self, words: np.ndarray, which: int):
        power, self.inverse = _powers(_BASES[which], len(words) + 1)
        self.sum = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _anchors(keys: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` keys in turn, the place of the least, the first among equals."""
    best, size = np.arange(len(keys)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        best = np.where(keys[right] < keys[left], right, left)
        size += step
    return best


def blocks_of(words: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """lo, hi (first and last window), anchor, content (hashes) of the blocks of a document, slice by slice."""
    gram = window // 2
    for a in range(0, len(words) - window + 1, SLICE):
        part = words[a : min(len(words), a + SLICE + window - 1)]
        at = np.arange(len(part) - gram + 1)
        own = _Runs(part, 0)
        keys = own.of(at, at + gram)
        chosen = _anchors(keys, window - gram + 1)
        lo = np.concatenate([[0], np.nonzero(chosen[1:] != chosen[:-1])[0] + 1])
        hi = np.concatenate([lo[1:], [len(chosen)]]) - 1
        # the words of all windows of the block, and where the anchor stands in them
        content = mix(_Runs(part, 1).of(lo, hi + window) + (chosen[lo] - lo).astype(np.uint64))
        yield a + lo, a + hi, keys[chosen[lo]].view(np.int64), content.view(np.int64)


def _row(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def _blocks(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, row, lo, hi, anchor, content."""
    names = ["doc_id", "row", "lo", "hi", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for d, r, t in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), strict=True):
                for lo, hi, anchor, content in blocks_of(word_hashes(t.as_py()), window):
                    held.append((np.full(len(lo), d), np.full(len(lo), r), lo.astype(np.int32), hi.astype(np.int32), anchor, content))
                    size += len(lo)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    return texts.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, row long, lo int, hi int, anchor long, content long")


def _windows(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """doc_id, row, at, k1, k2 of each window of the wanted blocks (doc_id, row, lo, hi)."""
    names = ["doc_id", "row", "at", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, r, t, spans in zip(*b.columns, strict=True):
                words = word_hashes(t.as_py())
                lo, hi = (np.array([s[k] for s in spans.as_py()], np.int64) for k in ("lo", "hi"))
                # blocks next to each other are hashed together, a bounded number of windows at a time
                order = np.argsort(lo)
                lo, hi = lo[order], hi[order]
                a = 0
                while a < len(lo):
                    z = a + max(1, int(np.searchsorted(hi[a:], lo[a] + SLICE)))
                    base = int(lo[a])
                    part = words[base : int(hi[z - 1]) + window]
                    n = hi[a:z] - lo[a:z] + 1
                    at = np.repeat(lo[a:z] - base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    keys = [_Runs(part, k).of(at, at + window).view(np.int64) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.as_py())) for x in (d, r)] + [pa.array((at + base).astype(np.int32)), *map(pa.array, keys)], names)
                    a = z

    lists = settle(wanted.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "boundaries")
    one = texts.join(lists, ["doc_id", "row"]).select("doc_id", "row", "text", "spans")
    return one.mapInArrow(run, "doc_id long, row long, at int, k1 long, k2 long")


def matches(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, start, end (words, half-open), source, source_start: stretches that the document ``source``, of a smaller id, holds word for word from ``source_start`` on, longer ones cut in pieces.

    Together they cover exactly the windows that start in a document of a smaller id.
    """
    texts = _texts(docs, id_col, text_col)
    blocks = settle(_blocks(texts, window), "blocks")
    # anchors that several documents hold: their blocks make the index, all others match nothing
    known = blocks.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.min("content").alias("c"), F.max("content").alias("d"))
    shared = settle(known.where("a < z").select("anchor", (F.col("c") < F.col("d")).alias("differ")), "anchors")
    index = settle(blocks.join(shared, "anchor"), "index")
    # minima are written before they meet their rows: a join of two tables is split where a key is hot
    first = settle(index.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "lo")).alias("f")), "firsts")
    placed = settle(index.join(first, ["anchor", "content"]).select("doc_id", "row", "lo", "hi", F.col("f.doc_id").alias("source"), F.col("f.lo").alias("source_start"), "differ"), "placed")
    whole = placed.where("source < doc_id").select("doc_id", "row", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"), "source", "source_start")
    # boundaries: blocks that differ from others of their anchor, each in the first document that has it
    own = settle(_windows(texts, placed.where("differ AND source = doc_id"), window), "windows")
    earliest = own.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last").drop("last")
    part = own.join(settle(earliest, "earliest"), ["k1", "k2"]).where("f.doc_id < doc_id").select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + window).alias("end"), F.col("f.doc_id").alias("source"), F.col("f.at").alias("source_start"))
    return whole.unionByName(part)


def factored(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, source_start) over matched pieces of the same form, which may overlap.

    From the left: pieces that continue each other in one source are one match; at each place the
    match that reaches farthest is taken, up to its end; then on from there, or from the next
    matched place.
    """
    grown: list[list[int]] = []
    last: dict[tuple[int, int], list[int]] = {}
    for start, end, source, at in sorted(pieces):
        own = last.get((source, start - at))
        if own is not None and start <= own[1]:
            own[1] = max(own[1], end)
        else:
            last[source, start - at] = own = [start, end, source, at]
            grown.append(own)
    out, place, k, best = [], 0, 0, None
    while True:
        while k < len(grown) and grown[k][0] <= place:
            best = grown[k] if best is None or grown[k][1] > best[1] else best
            k += 1
        if best is not None and best[1] > place:
            out.append((place, best[1], best[2], best[3] + place - best[0]))
            place = best[1]
        elif k < len(grown):
            place = grown[k][0]
        else:
            return out


def strip_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text (kept words joined by a space), factors (start, end, source, source_start; disjoint, in order) of every row."""
    found = matches(docs, window=window, id_col=id_col, text_col=text_col)
    lists = settle(found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end", "source", "source_start")).alias("pieces")), "pieces")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "factors"]
    factor = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                rows = [stripped(d.as_py(), t.as_py(), p.as_py()) for d, t, p in zip(*b.slice(a, 256).columns, strict=True)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), factor)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def stripped(doc_id, text, pieces) -> tuple:
        factors = factored([tuple(p.values()) for p in pieces or []])
        kept, at, k, removed = [], 0, 0, 0
        for words in word_slices(text):
            # the factors' parts in this slice go
            place, end = at, at + len(words)
            while place < end:
                while k < len(factors) and factors[k][1] <= place:
                    k += 1
                start, stop = factors[k][:2] if k < len(factors) else (end, end)
                if start > place:
                    kept.append(b" ".join(words[place - at : min(start, end) - at]))
                    place = min(start, end)
                else:
                    removed += min(stop, end) - place
                    place = min(stop, end)
            at = end
        whole = b" ".join(kept)
        return doc_id, at, removed, hashlib.sha256(whole).hexdigest(), whole.decode(), [dict(zip(("start", "end", "source", "source_start"), f, strict=True)) for f in factors]

    joined = _texts(docs, id_col, text_col).join(lists, ["doc_id", "row"], "left").select("doc_id", "text", "pieces")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, factors array<struct<start:int,end:int,source:bigint,source_start:int>>")
