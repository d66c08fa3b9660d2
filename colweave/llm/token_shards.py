"""Token ids as binary shards of patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents (ascending doc_id; ties by text; null
ids first), little-endian:

    magic 8 bytes | u32 ids per block | u32 documents | u64 ids | u32 blocks | u32 exceptions
    u64 x documents   ids of each document
    i64 x documents   doc_id            u8 x documents   1 where doc_id is null
    u32 x blocks      smallest id of the block
    u8  x blocks      bits of a packed delta, as 90 % of the block's deltas need
    u32 x (blocks+1)  block starts: byte offset in the packed area
    u32 x (blocks+1)  first exception of each block
    u8  x exceptions  place in the block
    u32 x exceptions  delta, whole
    packed area       each block by itself, so that one block can be read alone

Any block is found through the index of starts and decoded without its neighbours.
Files are written by executors under names that hold the attempt, and only the manifest of
successful attempts is read, so that lost executors and speculative copies leave no trace.
Defined results: a null text counts as empty (the end id alone); repeated rows are repeated
documents; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colweave.llm.store import new_path, settle, shuffle_width
from colweave.llm.worker import kept

MAGIC = b"PFORIDS1"
BLOCK = 128
#: Deltas of a block that the packed width covers; the others are exceptions.
PERCENTILE = 90
#: A shard is closed when it holds so many ids; a longer document fills one alone.
SHARD_IDS = 2_000_000
#: Entries that a worker's cache of word encodings holds before it starts afresh.
CACHE_ENTRIES = 1_000_000

#: A full stop or comma that may belong to a longer run of signs.
_RUN = re.compile(r"[^ 0-9A-Za-zÀ-ÖØ-öø-įı-ɏ][.,]")

_HEAD = struct.Struct("<8sIIQII")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard file's bytes from uint32 ids of documents one after the other."""
    n = len(ids)
    blocks = -(-n // block)
    full = np.zeros(blocks * block, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, block)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = full - low[:, None]
    at = min(block - 1, block * PERCENTILE // 100)
    width = _bits(np.partition(delta, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    outlier = (delta >> np.minimum(width, 31)[:, None] > 0) & (width < 32)[:, None]
    rows, cols = np.nonzero(outlier)
    starts = np.zeros(blocks + 1, np.uint32)
    starts[1:] = np.cumsum(width.astype(np.int64) * block // 8)
    first = np.zeros(blocks + 1, np.uint32)
    first[1:] = np.cumsum(outlier.sum(axis=1))
    area = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        own = np.nonzero(width == w)[0]
        for part in np.array_split(own, -(-len(own) // 2048)):
            # each delta as 4 bytes, least significant bit first; the lowest w bits stay
            bits = np.unpackbits(delta[part].astype("<u4").view(np.uint8).reshape(len(part), block, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            area[starts[part].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    head = _HEAD.pack(MAGIC, block, len(lengths), n, blocks, len(rows))
    parts = [lengths.astype("<u8"), doc_ids.astype("<i8"), null.astype(np.uint8), low.astype("<u4"), width, starts.astype("<u4"), first.astype("<u4"), cols.astype(np.uint8), delta[rows, cols].astype("<u4"), area]
    return head + b"".join(x.tobytes() for x in parts)


class Shard:
    """Random access to a shard file's bytes."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.n, self.blocks, outliers = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of packed token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.lengths, self.doc_ids, self.null = take("<u8", docs), take("<i8", docs), take("u1", docs)
        self.low, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.starts, self.first = take("<u4", self.blocks + 1), take("<u4", self.blocks + 1)
        self.place, self.value = take("u1", outliers), take("<u4", outliers)
        self.area = np.frombuffer(data, np.uint8, offset=at)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo..hi of the shard; only the blocks that hold them are decoded."""
        hi = self.n if hi is None else min(hi, self.n)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        out = np.zeros((b - a, self.block), np.uint32)
        width = self.width[a:b]
        for w in np.unique(width):
            if not w:
                continue
            own = np.nonzero(width == w)[0]
            for part in np.array_split(own, -(-len(own) // 2048)):
                raw = self.area[self.starts[a + part].astype(np.int64)[:, None] + np.arange(int(w) * self.block // 8)]
                bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), self.block, int(w))
                whole = np.zeros((len(part), self.block, 32), np.uint8)
                whole[:, :, :w] = bits
                out[part] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
        x0, x1 = int(self.first[a]), int(self.first[b])
        rows = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1].astype(np.int64)))
        out[rows, self.place[x0:x1]] = self.value[x0:x1]
        out += self.low[a:b, None]
        return out.reshape(-1)[lo - a * self.block : hi - a * self.block]


class WordEncoder(dict):
    """Encodings (uint32 bytes) of what stands between blanks, under a tokenizer whose pieces never reach over white space.

    A new word of Latin letters goes straight to the file's model, as its normaliser only
    lower-cases it and its pre-tokenizer leaves it whole; all else takes the full way.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.encode_one, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in plain)
        self.printable = str.maketrans({b: 256 + k for k, b in enumerate(rest)})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if word.isalpha() and max(word) < "\u0130":
            ids = np.array([t.id for t in self.tokenize(word.lower().encode().decode("latin-1").translate(self.printable))], "<u4").tobytes()
        elif word:
            ids = np.array(self.encode_one(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b""
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        if not _RUN.search(text):  # a stop after a letter or digit is a piece by itself
            text = text.replace(". ", " . ").replace(", ", " , ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def _encoder(path: str) -> WordEncoder:
    return kept(("encoder", path), lambda: WordEncoder(path))


def _filesystem(uri: str):
    """pyarrow's file system and path of a folder that Spark knows by ``uri``."""
    from pyarrow import fs

    uri = uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


MANIFEST = "part long, shard long, file string, first_doc long, docs long, ids long"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending id order under ``folder``.

    Returns the manifest (settled): part, shard, file, first_doc, docs, ids, in the order of
    (part, shard).  The tokenizer must not join pieces over white space, as one that drops
    white space doesn't; its special strings are handled as the library does by default.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(tokenizer_path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        files, root = _filesystem(folder)
        end = np.array([end_id], "<u4").tobytes()
        encoded, ids, null, held, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, shard
            lengths = np.array([len(x) // 4 for x in encoded], np.uint64)
            data = pack(np.frombuffer(b"".join(encoded), "<u4"), lengths, np.array(ids, np.int64), np.array(null, np.uint8))
            name = f"shard-{part:06d}-{shard:05d}-{attempt}.pfor"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            row = [part, shard, name, None if null[0] else ids[0], len(ids), int(lengths.sum())]
            for x in (encoded, ids, null):
                x.clear()
            held, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "file", "first_doc", "docs", "ids"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                encoded.append(own.encode(text.as_py() or "") + end)
                ids.append(doc_id.as_py() or 0)
                null.append(doc_id.as_py() is None)
                held += len(encoded[-1]) // 4
                if held >= SHARD_IDS:
                    yield close()
        if ids:
            yield close()

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return settle(ordered.mapInArrow(run, MANIFEST), "shards")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # offsets in two levels: over parts (one row each), then within a part
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")
    placed = manifest.withColumn("own", own).join(before, "part").select("file", (F.col("own") + F.col("before")).alias("start"))
    files_each = placed.repartition(shuffle_width(manifest.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                ids = shard.ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.lengths.astype(np.int64))
                data, crc, at = memoryview(ids).cast("B"), [], 0
                for e in ends.tolist():
                    crc.append(zlib.crc32(data[4 * at : 4 * e]))
                    at = e
                n = shard.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=shard.null.astype(bool)), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files_each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, *, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards (to a new folder in the shared one unless named) and read them back."""
    folder = folder or new_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, tokenizer_path, folder, end_id=end_id, id_col=id_col, text_col=text_col), folder)
