"""SimHash fingerprints and near-duplicate groups through multi-index hashing.

A fingerprint of 64 bits is cut into segments.  Of two fingerprints at most ``max_bits``
apart, one segment pair is at most max_bits // segments apart, so every fingerprint looks up
the small Hamming ball of each of its segments in a table of segment values and compares
whole fingerprints with what it finds.  Only distinct fingerprints take part; copies share
one.

Segment values that many fingerprints share are no longer compared pair by pair.  The
fingerprints concerned are keyed by whole points instead: two are within r bits exactly
if a point lies within r - r // 2 of one and r // 2 of the other.  All that meet at a point
hang on one of those whose nearer ball holds it, so the links stay linear in the keys and
connect the same groups.

Defined results: null and blank texts have fingerprint zero and link like any other; copies
of a row each get a row; a group whose ids are all null has component null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm.components import components
from colweave.llm.store import heavy_join, settle

#: Fingerprints that share a segment value up to this number are compared one by one.
BUCKET = 48

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is in over half of the shingles' XXH64."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, parts), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = len(parts) - words + 1
    shingles = map(joined.__getitem__, map(slice, starts[:n], ends[words - 1 :]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long); ``keep`` columns come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *keep])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *keep)
    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(run, f"doc_id long, fp long{kinds}")


def _masks(width: int, radius: int) -> list[int]:
    """Every pattern of at most ``radius`` set bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(fp: str, radius: int) -> F.Column:
    """All points within ``radius`` of a fingerprint, one row each."""
    masks = [_signed(m) for m in _masks(64, radius)]
    return F.explode(F.transform(F.lit(masks), lambda m: F.col(fp).bitwiseXOR(m)))


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect exactly those within ``max_bits``.

    Spark takes probes and points for as few as the fingerprints are, so joins ask for a shuffle.
    """
    cuts = [64 * s // segments for s in range(segments + 1)]
    value = lambda s: F.shiftrightunsigned("fp", cuts[s]).bitwiseAND((1 << (cuts[s + 1] - cuts[s])) - 1)
    # the number of the segment stands in the key's top bits, its value below
    key = lambda s, mask: value(s).bitwiseXOR(mask).bitwiseOR(s << 58)
    probes = F.array(*(key(s, F.lit(m)) for s in range(segments) for m in _masks(cuts[s + 1] - cuts[s], max_bits // segments)))
    table = fps.select("fp", F.explode(F.array(*(key(s, F.lit(0)) for s in range(segments)))).alias("key"))
    first = table.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("fp"))).where(F.col("n") <= bucket + 1)
    buckets = first.groupBy("key").agg(F.collect_list("fp").alias("found"))
    # a value that one fingerprint alone has can be fetched by others only
    near = F.filter("found", lambda x: (x < F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= max_bits))
    full = F.size("found") > bucket
    met = fps.select("fp", F.explode(probes).alias("key")).join(buckets.hint("merge"), "key").select("fp", full.alias("full"), F.when(full, F.array().cast("array<bigint>")).otherwise(near).alias("near"))
    met = settle(met.where(F.col("full") | (F.size("near") > 0)), "met")
    plain = met.select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    crowded = met.where("full").select("fp").distinct()
    low, high = max_bits // 2, max_bits - max_bits // 2
    if low == high:
        points = crowded.select("fp", _ball("fp", low).alias("point"), F.lit(True).alias("inner"))
        heads = points.groupBy("point").agg(F.min("fp").alias("head"))
    else:
        points = crowded.select("fp", _ball("fp", high).alias("point"))
        points = points.withColumn("inner", F.bit_count(F.col("point").bitwiseXOR(F.col("fp"))) <= low)
        heads = points.where("inner").groupBy("point").agg(F.min("fp").alias("head"))
    hung = points.join(heads.hint("merge"), "point").where("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return plain.unionByName(hung)


def near_duplicates(docs: DataFrame, *, words: int = 3, max_bits: int = 2, segments: int = 2, seed: int = 42, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp, component_id (the least doc_id that links reach)."""
    own = settle(fingerprints(docs, words=words, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    fps = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = components(links(fps.select("fp"), max_bits, segments, bucket)).select(F.col("node").alias("fp"), "component")
    named = fps.join(groups.hint("merge"), "fp")
    least = settle(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "components")
    linked = heavy_join(named.select("fp", "component"), least, "component", "m").select("fp", "component_id")
    each = settle(fps.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "groups")
    return heavy_join(own, each, "fp", "n").select("doc_id", "fp", "component_id")
