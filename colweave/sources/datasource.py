"""Spark data sources: ranges of columns of aligned files, and one file written from ordered parts.

``register(spark)`` makes them known as ``alignment`` and ``ordered_file``.

    spark.read.format("alignment").option("from", 1000000).option("to", 2000000).load("list.txt")
    write_ordered(raw_segmentation_parts(raw), "segmentation.bin")

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS), at the places that are
needed: a range of columns of a block gzip file reads the blocks that its index names for it.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from colweave.functions.scratch import ship
from colweave.sources.binary import _member, _open

#: Columns of a row of the source; columns of a partition.
STEP, SPAN = 1 << 16, 1 << 22


def _index(path: str) -> tuple[list[int], list[int]]:
    """Offsets of a block gzip file's blocks, compressed and not, from its .gzi file."""
    with _open(f"{path}.gzi") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        flat = struct.unpack(f"<{2 * n}Q", f.read(16 * n))
    c, u = [0, *flat[::2]], [0, *flat[1::2]]
    if any(a >= b for x in (c, u) for a, b in zip(x, x[1:], strict=False)):
        raise ValueError(f"offsets don't rise in the index of {path}")
    return c, u


def _members(data: bytes) -> bytes:
    """Everything that a run of gzip members holds."""
    out, at = [], 0
    while at < len(data):
        part, at = _member(data, at)
        out.append(part)
    return b"".join(out)


def read_columns(path: str, lb: int, rb: int | None) -> bytes:
    """Bytes [lb, rb) of a row's file (None: to its end, without white space there); of .gz files only the blocks around them are read."""
    if not path.endswith(".gz"):
        with _open(path) as f:
            f.seek(lb)
            data = f.read() if rb is None else f.read(rb - lb)
        return data.rstrip() if rb is None else data
    c, u = _index(path)
    first = bisect_right(u, lb) - 1
    last = len(u) if rb is None else bisect_right(u, rb - 1)
    with _open(path) as f:
        f.seek(c[first])
        data = _members(f.read(c[last] - c[first]) if last < len(c) else f.read())
    return data[lb - u[first] :].rstrip() if rb is None else data[lb - u[first] : rb - u[first]]


def row_length(path: str) -> int:
    """Columns of a row's file, from its end alone."""
    if path.endswith(".gz"):
        last = _index(path)[1][-1]
        return last + len(read_columns(path, last, None))
    with _open(path) as f:
        at = max(0, f.size() - 64)
        f.seek(at)
        return at + len(f.read().rstrip())


@dataclass
class Columns(InputPartition):
    """Columns [lb, rb) of one row."""

    seq_id: int
    path: str
    lb: int
    rb: int


class AlignmentReader(DataSourceReader):
    """Rows (seq_id, lb, chars) in the order of the list, each of ``step`` columns.

    Options: ``path`` of a list of files, one a line; ``from``, ``to``: columns [from, to),
    and no others are read; ``step``; ``span``, columns of a partition; ``reverse``: columns
    from the last to the first, chars backwards.  Bounds are options, since Spark keeps pushed
    filters of one query for later ones of the same DataFrame.
    """

    def __init__(self, options: dict):
        self.list, self.step, self.span = options["path"], int(options.get("step", STEP)), int(options.get("span", SPAN))
        self.backwards = str(options.get("reverse", "false")).lower() == "true"
        self.first, self.end, self.size = int(options.get("from", 0)), options.get("to"), None
        if self.step < 1 or self.span < 1 or self.first < 0:
            raise ValueError("step and span have to be positive, columns not negative")

    def paths(self) -> list[str]:
        """The list's files; relative names are beside the list."""
        with _open(self.list) as f:
            names = [x.strip() for x in f.read().decode().splitlines() if x.strip()]
        return [x if "://" in x or x.startswith("/") else posixpath.join(posixpath.dirname(self.list), x) for x in names]

    def columns(self) -> int:
        """Columns of the first row, which all others have to have as well."""
        if self.size is None:
            self.size = row_length(self.paths()[0])
        return self.size

    def partitions(self) -> Sequence[InputPartition]:
        paths = self.paths()
        if not paths:
            return []
        size = self.columns()
        end = size if self.end is None else min(size, int(self.end))
        wide = max(1, self.span // self.step) * self.step
        cuts = [(a, min(end, a + wide)) for a in range(self.first, end, wide)]
        return [Columns(k, p, a, z) for k, p in enumerate(paths) for a, z in (cuts[::-1] if self.backwards else cuts)]

    def read(self, partition: Columns | None) -> Iterator[tuple]:
        if partition is None:  # there are no partitions
            return
        size = row_length(partition.path)
        data = read_columns(partition.path, partition.lb, partition.rb).decode("latin-1")
        if len(data) < partition.rb - partition.lb or size != self.columns():
            raise ValueError(f"rows of unequal length: {partition.path} has {size} columns")
        starts = range(partition.lb, partition.rb, self.step)
        for lb in reversed(starts) if self.backwards else starts:
            chars = data[lb - partition.lb : lb - partition.lb + self.step]
            yield partition.seq_id, lb, chars[::-1] if self.backwards else chars


class AlignmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignment"

    def schema(self) -> str:
        return "seq_id int, lb bigint, chars string"

    def reader(self, schema) -> DataSourceReader:
        return AlignmentReader(self.options)


def _files(path: str):
    from pyarrow import fs

    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    files, inner = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return files, unquote(inner)


@dataclass
class Part(WriterCommitMessage):
    first: int
    last: int
    path: str


class OrderedFileWriter(DataSourceWriter):
    """Each task writes its rows (part, content) to a file of its own; the commit puts these together by their parts.

    Parts of different tasks must not lie between each other.  What a failed write leaves goes.
    """

    def __init__(self, path: str):
        self.path = path
        self.folder = f"{path}._parts-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator) -> Part | None:
        files, folder = _files(self.folder)
        files.create_dir(folder, recursive=True)
        name, first, last = f"{folder}/{uuid.uuid4().hex}", None, None
        with files.open_output_stream(name) as out:
            for r in rows:
                if last is not None and r["part"] <= last:
                    raise ValueError(f"part {r['part']} after part {last}")
                first, last = r["part"] if first is None else first, r["part"]
                out.write(bytes(r["content"]))
        return None if first is None else Part(first, last, name)

    def commit(self, messages: list) -> None:
        files, final = _files(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        try:
            if any(a.last >= b.first for a, b in zip(parts, parts[1:], strict=False)):
                raise ValueError("parts of different tasks overlap: deal rows by ranges of part")
            whole = f"{_files(self.folder)[1]}/whole"
            files.create_dir(_files(self.folder)[1], recursive=True)
            with files.open_output_stream(whole) as out:
                for p in parts:
                    with files.open_input_stream(p.path) as f:
                        while piece := f.read(1 << 20):
                            out.write(piece)
            files.move(whole, final)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        files, folder = _files(self.folder)
        if files.get_file_info(folder).type != FileType.NotFound:
            files.delete_dir(folder)


class OrderedFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OrderedFileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(AlignmentSource)
    spark.dataSource.register(OrderedFileSink)


def read_alignment(spark: SparkSession, path: str, lb: int = 0, rb: int | None = None, **options) -> DataFrame:
    """seq_id, lb, chars of columns [lb, rb) of the rows that a list names; only what meets them is read."""
    register(spark)
    bounds = {"from": lb} | ({} if rb is None else {"to": rb})
    return spark.read.format("alignment").options(**options, **bounds).load(path)


def write_ordered(parts: DataFrame, path: str) -> None:
    """One file at ``path`` of the rows' (part, content) contents in order of part."""
    register(parts.sparkSession)
    rows = parts.select(F.col("part").cast("bigint").alias("part"), F.col("content").cast("binary").alias("content"))
    rows.repartitionByRange("part").sortWithinPartitions("part").write.format("ordered_file").mode("append").save(path)
