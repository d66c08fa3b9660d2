"""Suffixes in sorted order, with what neighbours share: the base of prefix, order and count operators.

Suffixes are compared piece by piece.  The first piece of every suffix is sorted together
(dealt by ranges, so that no group of alike suffixes is one task's); only those that a piece
doesn't tell apart, and that someone needs told apart, are compared by the next one, twice as
long.  So repeats of any length are told apart, and the work follows the repeats there are.

Suffixes are made from texts, so Spark takes a table of them for as small as the texts' files
are, and would broadcast it; joins of two tables that grow with the texts ask for a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.scratch import settle

#: Characters of the first piece.
PIECE = 64
#: Characters of a block of text.
BLOCK = 1024
#: Stands for the end of a text in pieces, before all other characters of texts.
END = "\x01"


def cell_blocks(ranked: DataFrame, size: int) -> DataFrame:
    """text_id, block, text: ungapped rows in blocks of ``size`` characters, each followed by the next one."""
    own = ranked.where("ch <> '-'").withColumn("block", F.floor(F.col("nb") / size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nb", "ch"))), lambda x: x["ch"]), "")
    return _with_next(own.groupBy(F.col("seq_id").cast("bigint").alias("text_id"), "block").agg(text.alias("text")))


def text_blocks(texts: DataFrame, size: int) -> DataFrame:
    """The same of texts (text_id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, a // size, s[a : a + 2 * size], min(size, len(s) - a)) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a in range(0, len(s or ""), size)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], ["text_id", "block", "text", "own"])

    return texts.select(F.col("text_id").cast("bigint"), "s").mapInArrow(run, "text_id bigint, block bigint, text string, own int")


def _with_next(blocks: DataFrame) -> DataFrame:
    own = settle(blocks, "text-blocks")
    after = own.select("text_id", (F.col("block") - 1).alias("block"), F.col("text").alias("after"))
    return own.join(after.hint("merge"), ["text_id", "block"], "left").select("text_id", "block", F.concat("text", F.coalesce("after", F.lit(""))).alias("text"), F.length("text").alias("own"))


def pieces(wanted: DataFrame, blocks: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """wanted (text_id, pos, ...) with piece: the ``length`` characters from pos + offset on (at most ``size``), padded by END."""
    at = F.col("pos") + offset
    placed = wanted.withColumn("block", F.floor(at / size)).join(blocks.select("text_id", "block", "text").hint("merge"), ["text_id", "block"], "left")
    piece = F.substring(F.coalesce("text", F.lit("")), (F.pmod(at, F.lit(size)) + 1).cast("int"), F.lit(length))
    return placed.select(*wanted.columns, F.rpad(piece, length, END).alias("piece"))


def windows(blocks: DataFrame, length: int) -> DataFrame:
    """text_id, pos, win: the next characters (``length`` at most, and no more than a block's) from every position."""
    spread = blocks.select("text_id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    first = blocks.agg(F.max("own")).first()[0] or 1
    return spread.select("text_id", (F.col("block") * first + F.col("i")).cast("bigint").alias("pos"), F.substring(F.col("text"), F.col("i") + 1, F.lit(length)).alias("win"))


def _sorted_part(offset: int, length: int):
    """A function over one sorted part: place in it, class, and what each row shares with its neighbours."""
    names = ["part", "at", "text_id", "pos", "size", "group", "up", "down", "class", "edge"]

    def shared(piece: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each two rows in turn: characters shared (-1 between groups), and whether they are alike."""
        n = len(piece) - 1
        count = np.full(n, length, np.int64)
        step = max(1, (1 << 22) // length)
        for a in range(0, n, step):
            z = min(n, a + step)
            letters = piece[a : z + 1].view(np.uint32).reshape(z + 1 - a, length)
            apart = letters[1:] != letters[:-1]
            count[a:z] = np.where(apart.any(axis=1), apart.argmax(axis=1), length)
        same = group[1:] == group[:-1]
        return np.where(same, offset + count, -1), same & (count == length)

    def rows(part, at, kept, up, down, klass, edge) -> pa.RecordBatch:
        text_id, pos, size, group = kept
        n = len(pos)
        cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(text_id), pa.array(pos), pa.array(size), pa.array(group), pa.array(up.astype(np.int32)), pa.array(down.astype(np.int32)), pa.array(klass), pa.array(edge, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, klass, up0, part = None, 0, 0, -2, 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            own = [b.column(k).to_numpy() for k in (1, 2, 3, 4)]
            piece = np.array(b.column(5).to_pylist(), f"<U{length}")
            if held is not None:
                own = [np.concatenate([x, y]) for x, y in zip(held[0], own, strict=True)]
                piece = np.concatenate([held[1], piece])
            count, alike = shared(piece, own[3])
            n = len(count)
            if n:
                classes = klass + np.concatenate([[0], np.cumsum(~alike)])
                edge = [str(piece[0]) if at + k == 0 else None for k in range(n)]
                yield rows(part, at, [x[:n] for x in own], np.concatenate([[up0], count[:-1]]), count, classes[:n], edge)
                at, klass, up0 = at + n, int(classes[n]), int(count[-1])
            held = [x[n:] for x in own], piece[n:]
        if held is not None:  # the last row of the part: -2 stands for a neighbour in another part
            yield rows(part, at, held[0], np.array([up0]), np.array([-2]), np.array([klass]), [str(held[1][0])])

    return run, "part int, at bigint, text_id bigint, pos bigint, size bigint, `group` bigint, up int, down int, `class` bigint, edge string"


def _edges_joined(offset: int, length: int):
    """A function over the first and last rows of all parts in order: where ranks and classes of each part start, and what it shares with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        parts: list[list[dict]] = []
        for r in rows:
            if parts and parts[-1][0]["part"] == r["part"]:
                parts[-1].append(r)
            else:
                parts.append([r])
        out, rank, klass = [], 0, 0
        for k, p in enumerate(parts):
            first, last = p[0], p[-1]
            up, alike = -1, False
            if k and parts[k - 1][-1]["group"] == first["group"]:
                a, b = parts[k - 1][-1]["edge"], first["edge"]
                n = next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), length)
                up, alike = offset + n, n == length
            klass += 0 if alike or not k else 1
            if out:
                out[-1]["last_down"] = up
            out.append({"part": first["part"], "rank0": rank, "class0": klass, "first_up": up, "last_down": -1})
            rank, klass = rank + last["at"] + 1, klass + last["class"]
        schema = pa.schema([("part", pa.int32()), ("rank0", pa.int64()), ("class0", pa.int64()), ("first_up", pa.int32()), ("last_down", pa.int32())])
        yield pa.RecordBatch.from_pylist(out, schema)

    return run, "part int, rank0 bigint, class0 bigint, first_up int, last_down int"


def sorted_suffixes(cut: DataFrame, offset: int, length: int) -> DataFrame:
    """text_id, pos, size, group, rank, up, down, class of suffixes (text_id, pos, size, group, piece), written once.

    ``rank`` runs from 0 along (group, piece, text_id, pos); ``up`` and ``down`` are the
    characters that a suffix shares with the one before and after it within its group, the
    ``offset`` that the group shares included (-1: none); suffixes of one ``class`` have equal
    group and piece.
    """
    width = max(1, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["group", "piece", "text_id", "pos"]
    dealt = cut.repartitionByRange(width, *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "text_id", "pos", F.col("size").cast("bigint"), "group", "piece")
    run, schema = _sorted_part(offset, length)
    parts = settle(dealt.mapInArrow(run, schema), "sorted-suffixes")
    run, schema = _edges_joined(offset, length)
    # two rows of each part at most
    edges = parts.where("edge IS NOT NULL").select("part", "at", "group", "class", "edge").repartition(1).sortWithinPartitions("part", "at").mapInArrow(run, schema)
    joined = parts.join(F.broadcast(settle(edges, "part-edges")), "part")
    up = F.when(F.col("up") == -2, F.col("first_up")).otherwise(F.col("up"))
    down = F.when(F.col("down") == -2, F.col("last_down")).otherwise(F.col("down"))
    return joined.select("text_id", "pos", "size", "group", (F.col("rank0") + F.col("at")).alias("rank"), up.alias("up"), down.alias("down"), (F.col("class0") + F.col("class")).alias("class"))


def suffix_order(texts: DataFrame, length: int = PIECE) -> DataFrame:
    """text_id, pos, idx (rank from 0 among all suffixes, equal ones by text_id and pos), lcp (with the one before), ch (before it, '$' at the start).

    Exact for repeats of any length.
    """
    size = F.length("s")
    now = texts.where(size > 0).select(F.col("text_id").cast("bigint"), F.explode(F.sequence(F.lit(0).cast("bigint"), size.cast("bigint") - 1)).alias("pos"), size.cast("bigint").alias("all"))
    return _order(now.select("text_id", "pos", (F.col("all") - F.col("pos")).alias("size")), lambda n: text_blocks(texts, n), length)


def cell_order(ranked: DataFrame, length: int = PIECE) -> DataFrame:
    """The same of the ungapped rows of an alignment, whose rows aren't put together for it; text_id is seq_id."""
    kept = ranked.where("ch <> '-'")
    # a row for each text, written so that Spark sees how few they are
    sizes = settle(kept.groupBy("seq_id").agg(F.count("*").alias("all")), "totals")
    now = kept.join(sizes, "seq_id").select(F.col("seq_id").cast("bigint").alias("text_id"), F.col("nb").cast("bigint").alias("pos"), (F.col("all") - F.col("nb")).alias("size"))
    return _order(now, lambda n: cell_blocks(ranked, n), length)


def _order(suffixes: DataFrame, blocks_of: Callable[[int], DataFrame], length: int) -> DataFrame:
    """The order of all suffixes (text_id, pos, size) of texts that ``blocks_of`` gives in blocks of a size."""
    placed, blocks = order_among(suffixes, blocks_of, length)
    before = windows(blocks, 1).select("text_id", (F.col("pos") + 1).alias("pos"), F.col("win").alias("ch"))
    return placed.join(before.hint("merge"), ["text_id", "pos"], "left").select("text_id", F.col("pos").cast("int").alias("pos"), "idx", "lcp", F.coalesce("ch", F.lit("$")).alias("ch"))


def order_among(suffixes: DataFrame, blocks_of: Callable[[int], DataFrame], length: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """text_id, pos, idx, lcp of the given suffixes (text_id, pos, size) among themselves; and the last blocks of texts."""
    now = suffixes.withColumn("group", F.lit(0).cast("bigint"))
    blocks = settle(blocks_of(BLOCK), "blocks")
    base = None
    offset, step = 0, length
    parts: list[DataFrame] = []
    while True:
        if step > BLOCK:
            blocks = settle(blocks_of(step), "blocks")
        placed = sorted_suffixes(pieces(now, blocks, max(BLOCK, step), offset, step), offset, step)
        # a group's places start at its rank in the round before; its first suffix shares what the group shared
        if base is None:
            placed = placed.select("*", F.col("rank").alias("idx"), F.greatest("up", F.lit(0)).alias("lcp"))
        else:
            starts = placed.groupBy("group").agg(F.min("rank").alias("rank0")).join(base.hint("merge"), "group")
            placed = placed.join(starts.hint("merge"), "group").select(*placed.columns, (F.col("first_idx") + F.col("rank") - F.col("rank0")).alias("idx"), F.when(F.col("up") < 0, F.col("first_lcp")).otherwise(F.col("up")).alias("lcp"))
        placed = settle(placed, "placed")
        # those that share a piece, and go on after it
        crowd = placed.groupBy("class").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min(F.struct("idx", "lcp")).alias("first")).where((F.col("n") > 1) & (F.col("most") > offset + step))
        crowd = settle(crowd.select("class", "first"), "crowd")
        if crowd.isEmpty():
            parts.append(placed.select("text_id", "pos", "idx", "lcp", "size"))
            break
        rest = placed.join(crowd.hint("merge"), "class", "left")
        parts.append(rest.where("first IS NULL").select("text_id", "pos", "idx", "lcp", "size"))
        now = settle(rest.where("first IS NOT NULL").select("text_id", "pos", "size", F.col("class").alias("group")), "rest")
        base = crowd.select(F.col("class").alias("group"), F.col("first.idx").alias("first_idx"), F.col("first.lcp").alias("first_lcp"))
        offset, step = offset + step, offset + step
    last = parts[0]
    for p in parts[1:]:
        last = last.unionByName(p)
    return last.select("text_id", F.col("pos").cast("bigint").alias("pos"), F.col("idx").cast("bigint").alias("idx"), F.least(F.col("lcp"), F.col("size")).cast("int").alias("lcp")), blocks
