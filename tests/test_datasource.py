"""Ranges of columns read through a data source, and one file written from ordered parts."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from colweave.sources import binary as S
from colweave.sources import datasource as D


@pytest.fixture(scope="module")
def aligned(tmp_path_factory):
    """Five rows of 3 000 columns: plain, with a line end, and block gzip; and the lists that name them."""
    folder = tmp_path_factory.mktemp("aligned")
    r = random.Random(1)
    rows = ["".join(r.choice("ACGT-") for _ in range(3000)) for _ in range(5)]
    names = []
    for k, s in enumerate(rows):
        gz = k in (1, 3, 4)
        data, index = S.block_gzip(s.encode() + b"\n" * (k == 4), 400)
        names.append(f"{folder}/r{k}.{'gz' if gz else 'txt'}")
        with open(names[-1], "wb") as f:
            f.write(data if gz else s.encode() + b"\n" * (k == 2))
        if gz:
            with open(f"{names[-1]}.gzi", "wb") as f:
                f.write(index)
    (folder / "all.txt").write_text("\n".join(names[::-1]) + "\n\n")
    (folder / "names.txt").write_text("\n".join(os.path.basename(x) for x in names))
    return str(folder), rows


@pytest.mark.parametrize(("lb", "rb", "step"), [(0, None, 700), (0, 3000, 3000), (995, 1005, 100), (399, 1201, 400), (2999, 5000, 64), (1, 2, 1)])
def test_column_ranges(spark, aligned, lb, rb, step):
    folder, rows = aligned
    for name, own in (("all.txt", rows[::-1]), ("names.txt", rows)):
        got = D.read_alignment(spark, f"{folder}/{name}", lb, rb, step=step, span=2 * step).collect()
        assert [(r.seq_id, r.lb) for r in got] == sorted((r.seq_id, r.lb) for r in got)  # in the order of the list
        assert {k: "".join(r.chars for r in got if r.seq_id == k) for k in range(5)} == {k: s[lb:rb] for k, s in enumerate(own)}
        assert all(own[r.seq_id][r.lb : r.lb + len(r.chars)] == r.chars for r in got)


def test_backwards(spark, aligned):
    folder, rows = aligned
    got = D.read_alignment(spark, f"{folder}/names.txt", 450, 2222, step=500, span=1000, reverse="true").collect()
    for k in range(5):
        own = [r for r in got if r.seq_id == k]
        assert [r.lb for r in own] == sorted((r.lb for r in own), reverse=True)
        assert "".join(r.chars for r in own) == rows[k][450:2222][::-1]


def test_only_blocks_of_the_range_are_read(spark, aligned, monkeypatch):
    folder, rows = aligned
    reads = []

    class Counted:
        def __init__(self, path):
            self.path, self.f = path, open_(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def size(self):
            return self.f.size()

        def read(self, *n):
            data = self.f.read(*n)
            reads.append((self.path, len(data)))
            return data

    open_ = D._open
    monkeypatch.setattr(D, "_open", Counted)
    path = f"{folder}/r3.gz"
    assert D.read_columns(path, 1210, 1590).decode() == rows[3][1210:1590]
    content = [n for p, n in reads if p == path]
    entries = D._index(path)[0]
    assert content == [entries[4] - entries[3]]  # one block of 400 of the file's eight
    reader = D.AlignmentReader({"path": f"{folder}/names.txt", "from": "1210", "to": "1590", "step": "100", "span": "200"})
    parts = list(reader.partitions())
    assert [(p.seq_id, p.lb, p.rb) for p in parts] == [(k, a, z) for k in range(5) for a, z in ((1210, 1410), (1410, 1590))]
    reads.clear()
    assert [r[1:] for r in reader.read(parts[6])] == [(1210, rows[3][1210:1310]), (1310, rows[3][1310:1410])]
    # the block of the range, and for the row's length the last one
    assert [n for p, n in reads if p == path] == [os.path.getsize(path) - entries[-1], entries[4] - entries[3]]


def test_filters_on_the_source(spark, aligned):
    folder, rows = aligned
    D.register(spark)
    df = spark.read.format("alignment").option("step", "100").load(f"{folder}/names.txt")
    assert df.where("lb >= 1000 AND lb < 1200 AND seq_id < 2").count() == 4
    assert [r.chars for r in df.where("lb = 2900").orderBy("seq_id").collect()] == [s[2900:] for s in rows]
    assert df.where("lb > 2900").count() == 0 and df.count() == 150


def test_rows_of_unequal_length(spark, tmp_path):
    for k, n in enumerate((100, 90, 110)):
        (tmp_path / f"{k}").write_text("A" * n)
    for second in (1, 2):
        (tmp_path / "list").write_text(f"{tmp_path}/0\n{tmp_path}/{second}\n")
        with pytest.raises(Exception, match="unequal"):
            D.read_alignment(spark, str(tmp_path / "list"), step=40).collect()
    (tmp_path / "none").write_text("\n")
    assert D.read_alignment(spark, str(tmp_path / "none")).collect() == []


def test_segmentation_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PART", 7)
    raw = spark.createDataFrame([(k, None if k % 5 == 0 else k + 3) for k in range(100)], "lb bigint, rb bigint").repartition(6)
    D.write_ordered(S.raw_segmentation_parts(raw), str(tmp_path / "raw.bin"))
    assert sorted(map(str, S.read_raw_segmentation(spark, str(tmp_path / "raw.bin")).collect())) == sorted(map(str, raw.collect()))
    data = (tmp_path / "raw.bin").read_bytes()
    assert struct.unpack("<QQ", data[:16]) == (100, 102) and len(data) == 8 * 101  # the last column comes first
    seg = spark.createDataFrame([(k, 3 * k, 3 * k + 3) for k in range(40)], "block_idx int, lb bigint, rb bigint")
    D.write_ordered(S.segmentation_parts(seg), str(tmp_path / "seg.bin"))
    assert sorted(S.read_segmentation(spark, str(tmp_path / "seg.bin")).collect()) == sorted(seg.collect())
    assert sorted(x.name for x in tmp_path.iterdir()) == ["raw.bin", "seg.bin"]  # no parts are left


def test_text_files_and_aborts(spark, tmp_path):
    lines = spark.range(1000).select(F.col("id").alias("part"), F.concat(F.lit("é"), F.col("id").cast("string"), F.lit("#")).alias("content"))
    D.write_ordered(lines.repartition(9), str(tmp_path / "text"))
    assert (tmp_path / "text").read_text() == "".join(f"é{k}#" for k in range(1000))
    with pytest.raises(Exception, match="after part"):
        D.write_ordered(lines.unionByName(lines), str(tmp_path / "again"))
    bad = lines.repartition(3)  # not dealt by ranges
    with pytest.raises(Exception, match="overlap|after part"):
        bad.select("part", F.col("content").cast("binary")).sortWithinPartitions("part").write.format("ordered_file").mode("append").save(str(tmp_path / "mixed"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["text"]
