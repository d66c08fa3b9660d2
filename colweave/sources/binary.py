"""Binary formats: block gzip with its index, segmentations as 64-bit integers, packed-vector headers, byte ranges."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.operators.tools import merged_ranges

#: Value that stands for "no valid right bound" (fixed value).
NO_BOUND = (1 << 64) - 1
#: The empty block at the end of a block gzip file (fixed value).
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _mapped(df: DataFrame, parse, schema: str, types: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse(p, c)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def read_block_index(spark: SparkSession, path: str) -> DataFrame:
    """path, block, c_off, u_off from .gzi files: a first entry at 0 and strictly rising offsets."""

    def parse(p: str, c: bytes):
        (n,) = struct.unpack_from("<Q", c)
        flat = struct.unpack_from(f"<{2 * n}Q", c, 8)
        pairs = [(0, 0), *zip(flat[::2], flat[1::2], strict=True)]
        if any(a[0] >= b[0] or a[1] >= b[1] for a, b in zip(pairs, pairs[1:], strict=False)):
            raise ValueError(f"offsets don't rise in {p}")
        return [(p, k, a, b) for k, (a, b) in enumerate(pairs)]

    return _mapped(_contents(spark, path), parse, "path string, block int, c_off bigint, u_off bigint", [pa.string(), pa.int32(), pa.int64(), pa.int64()], ["path", "block", "c_off", "u_off"])


def _member(c, at: int) -> tuple[bytes, int]:
    """Data of the gzip member at ``at`` of a buffer, and where the next one starts."""
    # block gzip names a member's size in its header; others are fed until they end
    known = c[at + 12 : at + 16] == b"BC\x02\x00" and c[at + 3] & 4
    size = struct.unpack_from("<H", c, at + 16)[0] + 1 if known else 1 << 16
    d, parts, now = zlib.decompressobj(31), [], at
    while not d.eof:
        if now >= len(c):
            raise ValueError("a member ends early")
        piece = c[now : now + size]
        parts.append(d.decompress(piece))
        now += len(piece)
    return b"".join(parts), now - len(d.unused_data)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, block, c_off, u_off, data: the members of block gzip files; a missing end block raises."""

    def parse(p: str, c: bytes):
        if not c.endswith(END_BLOCK):
            raise ValueError(f"no end block in {p}")
        out, at, u, k = [], 0, 0, 0
        while at < len(c):
            data, after = _member(c, at)
            if data:
                out.append((p, k, at, u, data))
            at, u, k = after, u + len(data), k + 1
        return out

    return _mapped(_contents(spark, path), parse, "path string, block int, c_off bigint, u_off bigint, data binary", [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], ["path", "block", "c_off", "u_off", "data"])


def _open(path: str):
    """A file of any shared or local file system, for reads at any place."""
    from pyarrow import fs

    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    files, inner = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return files.open_input_file(unquote(inner))


def _ranges(df: DataFrame, parse, names: list[str]) -> DataFrame:
    """Rows (path, number, at, size, more ...) to (path, number, u_off, data) by reads of that range only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with _open(row["path"]) as f:
                    f.seek(row["at"])
                    u_off, data = parse(row, f.read(row["size"]))
                if data:
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["number"]], pa.int64()), pa.array([u_off], pa.int64()), pa.array([data], pa.binary())], names)

    return df.mapInArrow(run, f"path string, {names[1]} bigint, u_off bigint, data binary")


def read_gzip_range(spark: SparkSession, path: str, lb: int, rb: int, *, index: str | None = None, reverse: bool = False) -> DataFrame:
    """path, block, u_off, data: bytes [lb, rb) of the uncompressed content, a row for each block that they meet.

    Only these blocks are read, each once, by the index's offsets (``path`` with .gzi unless
    named).  With ``reverse`` each row's bytes run backwards, and blocks are to be taken from
    the last to the first; u_off is where the row's bytes start in the content either way.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    entries = read_block_index(spark, index or f"{path}.gzi").select(F.regexp_replace("path", r"\.gzi$", "").alias("path"), "block", "c_off", "u_off") if index is None else read_block_index(spark, index).drop("path").crossJoin(sizes.select("path"))  # one file
    order = Window.partitionBy("path").orderBy("block")
    ends = entries.withColumn("c_end", F.lead("c_off").over(order)).withColumn("u_end", F.lead("u_off").over(order)).join(sizes, "path")
    met = ends.where((F.col("u_off") < rb) & (F.coalesce("u_end", F.lit(NO_BOUND >> 1)) > lb))
    asked = met.select("path", F.col("block").cast("bigint").alias("number"), F.col("c_off").alias("at"), (F.coalesce("c_end", "length") - F.col("c_off")).alias("size"), "u_off")
    asked = asked.repartition("path", "number")

    def parse(row: dict, c: bytes) -> tuple[int, bytes]:
        data = _member(c, 0)[0]
        a, z = max(0, lb - row["u_off"]), max(0, min(len(data), rb - row["u_off"]))
        cut = data[a:z]
        return row["u_off"] + a, cut[::-1] if reverse else cut

    return _ranges(asked, parse, ["path", "block", "u_off", "data"])


def file_chunks(spark: SparkSession, path: str, size: int = 1 << 14) -> DataFrame:
    """path, chunk, u_off, data: files in chunks of ``size`` bytes, read range by range."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    many = sizes.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("number"))
    asked = many.select("path", F.col("number").cast("bigint").alias("number"), (F.col("number") * size).cast("bigint").alias("at"), F.least(F.lit(size).cast("bigint"), F.col("length") - F.col("number") * size).alias("size")).repartition("path", "number")
    return _ranges(asked, lambda row, c: (row["at"], c), ["path", "chunk", "u_off", "data"])


def remove_byte_ranges(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """chunks without the bytes of the half-open ranges (lb, rb); rows left empty go, the rest follow each other by path and chunk."""
    size = chunks.agg(F.max(F.length("data"))).first()[0] or 1
    spread = merged_ranges(ranges).select("lb", "rb", F.explode(F.sequence(F.floor(F.col("lb") / size), F.floor((F.col("rb") - 1) / size))).alias("chunk"))
    cuts = spread.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("lb", "rb"))).alias("cuts"))
    joined = chunks.join(cuts, "chunk", "left").select("path", "chunk", "u_off", "data", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for row in b.to_pylist():
                out, at = [], 0
                for cut in row["cuts"] or []:
                    out.append(row["data"][at : max(at, cut["lb"] - row["u_off"])])
                    at = max(at, cut["rb"] - row["u_off"])
                kept.append(b"".join([*out, row["data"][at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary())], ["path", "chunk", "kept"])

    return joined.mapInArrow(run, "path string, chunk bigint, kept binary").where(F.length("kept") > 0)


def blocks_of_range(index: DataFrame, lb: int, rb: int) -> DataFrame:
    """Index entries whose uncompressed bytes meet [lb, rb)."""
    end = F.lead("u_off").over(Window.partitionBy("path").orderBy("block"))
    return index.withColumn("u_end", end).where((F.col("u_off") < rb) & (F.coalesce("u_end", F.lit(NO_BOUND >> 1)) > lb))


def same_layout(index: DataFrame) -> DataFrame:
    """block, agrees: whether all files have the block at one uncompressed offset."""
    return index.groupBy("block").agg((F.count_distinct("u_off") == 1).alias("agrees"))


def block_gzip(data: bytes, size: int = 65_280) -> tuple[bytes, bytes]:
    """A block gzip file's bytes and its index's."""
    out, entries, u = b"", [], 0
    for at in range(0, len(data), size):
        part = data[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        if at:
            entries.append((len(out), u))
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        u += len(part)
    index = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<QQ", *e) for e in entries)
    return out + END_BLOCK, index


def read_raw_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """lb, rb (closed; null: none) from a count and that many right bounds, last column first."""

    def parse(p: str, c: bytes):
        (n,) = struct.unpack_from("<Q", c)
        values = struct.unpack_from(f"<{n}Q", c, 8)
        return [(n - 1 - k, None if v == NO_BOUND else v) for k, v in enumerate(values)]

    return _mapped(_contents(spark, path), parse, "lb bigint, rb bigint", [pa.int64(), pa.int64()], ["lb", "rb"])


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """block_idx, lb, rb (half-open) from a count and that many right bounds."""

    def parse(p: str, c: bytes):
        (n,) = struct.unpack_from("<Q", c)
        ends = struct.unpack_from(f"<{n}Q", c, 8)
        return [(k, a, b) for k, (a, b) in enumerate(zip((0, *ends), ends, strict=False))]

    return _mapped(_contents(spark, path), parse, "block_idx int, lb bigint, rb bigint", [pa.int32(), pa.int64(), pa.int64()], ["block_idx", "lb", "rb"])


#: Values in one part of a segmentation file.
PART = 1 << 16


def _packed(values: DataFrame, place: F.Column) -> DataFrame:
    """part, content: a file of a count and the values v as 64-bit integers in order of ``place`` (from 0), in parts to be put together in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        flat = [NO_BOUND if v is None else v for v in table["v"].to_pylist()]
        return pa.table([pa.array([table["part"][0].as_py()], pa.int64()), pa.array([struct.pack(f"<{len(flat)}Q", *flat)], pa.binary())], ["part", "content"])

    dealt = values.select("v", place.cast("bigint").alias("at")).withColumn("part", F.floor(F.col("at") / PART) + 1)
    # the count, least significant byte first
    n = F.count("*").alias("n")
    head = values.agg(n).select(F.lit(0).cast("bigint").alias("part"), F.reverse(F.array(*(F.shiftright("n", 8 * k).bitwiseAND(255) for k in range(7, -1, -1)))).alias("bytes"))
    text = F.array_join(F.transform("bytes", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return head.select("part", F.unhex(text).alias("content")).unionByName(dealt.groupBy("part").applyInArrow(run, "part bigint, content binary"))


def raw_segmentation_parts(raw: DataFrame) -> DataFrame:
    last = raw.agg(F.max("lb").alias("last"))  # one row
    return _packed(raw.crossJoin(last).select(F.col("rb").alias("v"), (F.col("last") - F.col("lb")).alias("at")), F.col("at"))


def segmentation_parts(seg: DataFrame) -> DataFrame:
    return _packed(seg.select(F.col("rb").alias("v"), F.col("block_idx").alias("at")), F.col("at"))


def read_vector_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, bits, width, head: length in bits, item width and first ten bytes of packed integer vectors."""

    def parse(p: str, c: bytes):
        bits, width = struct.unpack_from("<QB", c)
        return [(p, bits, width, c[:10].hex())]

    return _mapped(_contents(spark, path), parse, "path string, bits bigint, width int, head string", [pa.string(), pa.int64(), pa.int32(), pa.string()], ["path", "bits", "width", "head"])


def vector_header(bits: int, width: int) -> bytes:
    if bits < 0:
        raise ValueError("negative length")
    return struct.pack("<QB", bits, width)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """lb, rb from lines of two integers between white space; lb < rb is asserted."""
    cut = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).where("trim(value) <> ''").select(F.get(cut, 0).cast("bigint").alias("lb"), F.get(cut, 1).cast("bigint").alias("rb"))
    return pairs.where(F.assert_true(F.col("lb") < F.col("rb"), "an empty range").isNull())


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern: the tokens of a file, the last one with or without a line end."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("pattern")).where("pattern <> ''")
