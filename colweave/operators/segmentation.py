"""Semi-repeat-free column ranges: shortest unique prefixes, right bounds, optimal segmentations.

The members of a column are, row by row, the suffixes of the ungapped rows that start at the
next non-gap cell.  A row's unique prefix length d at a column is the least L such that
every occurrence of its suffix's first L characters, in any row, is a member.  A column is
valid if all rows have one, and its right bound is the rightmost column that any of these
prefixes reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.functions.scratch import settle
from colweave.operators import suffixes as S

#: Columns whose chain of blocks one task follows.
STRETCH = 65_536


def unique_prefixes(ranked: DataFrame, length: int = S.PIECE) -> DataFrame:
    """col, seq_id, nb, d: length of the shortest unique prefix (null: none), whatever it is.

    d is 1 + the most characters that a suffix shares with a non-member, and that is the
    nearest non-member in sorted order.  Members of a column that stand next to each other in
    that order form an island, so what each shares with the non-members around its island is
    the least of what neighbours share on the way there.  Suffixes are compared by pieces of
    ``length`` characters first; only columns whose members share a whole piece with a
    non-member are looked at again, with pieces twice as long, until none is left.
    """
    # a row for each text, written so that Spark sees how few they are
    total = settle(ranked.where("ch <> '-'").groupBy("seq_id").agg(F.count("*").alias("all")), "totals")
    cells = settle(ranked.join(total, "seq_id", "left").select("col", F.col("seq_id").cast("bigint").alias("text_id"), F.col("nb").cast("bigint").alias("pos"), (F.coalesce("all", F.lit(0)) - F.col("nb")).alias("size"), (F.col("ch") != "-").alias("kept")), "members")
    members = cells.where("size > 0").select("col", "text_id", "pos")
    found = [cells.where("size <= 0").select("col", "text_id", "pos", F.lit(None).cast("int").alias("d"))]
    blocks = settle(S.cell_blocks(ranked, S.BLOCK), "blocks")
    if length > S.BLOCK:
        blocks = settle(S.cell_blocks(ranked, length), "blocks")
    # at first all suffixes are wanted: their pieces are cut where the blocks are
    first = S.windows(blocks, length).join(total.select(F.col("seq_id").cast("bigint").alias("text_id"), "all"), "text_id")
    cut = first.select("text_id", "pos", (F.col("all") - F.col("pos")).alias("size"), F.lit(0).cast("bigint").alias("group"), F.rpad("win", length, S.END).alias("piece"))
    offset, step = 0, length
    while True:
        placed = S.sorted_suffixes(cut, offset, step)
        # the windows below are all within a column
        each = members.join(placed.hint("merge"), ["text_id", "pos"]).repartition("col")
        island = each.withColumn("island", F.col("rank") - F.row_number().over(Window.partitionBy("col", "group").orderBy("rank")))
        order = Window.partitionBy("col", "group", "island").orderBy("rank")
        left = F.min("up").over(order.rowsBetween(Window.unboundedPreceding, 0))
        right = F.min("down").over(order.rowsBetween(0, Window.unboundedFollowing))
        reach = island.select("col", "text_id", "pos", "size", "class", F.greatest(left, right, F.lit(0)).alias("reach"))
        open_ = F.max((F.col("reach") >= offset + step) & (F.col("size") > offset + step)).over(Window.partitionBy("col", "class"))
        reach = settle(reach.withColumn("open", open_), "reach")
        d = (F.col("reach") + 1).cast("int")
        found.append(reach.where("NOT open").select("col", "text_id", "pos", F.when(d <= F.col("size"), d).alias("d")))
        more = reach.where("open")
        if more.isEmpty():
            break
        # their classes are the next groups: nothing else shares so much with them
        members = more.select("col", "text_id", "pos")
        now = placed.join(more.select("class").distinct().hint("merge"), "class").select("text_id", "pos", "size", F.col("class").alias("group"))
        offset, step = offset + step, offset + step
        if step > S.BLOCK:
            blocks = settle(S.cell_blocks(ranked, step), "blocks")
        cut = S.pieces(now, blocks, max(S.BLOCK, step), offset, step)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("col", F.col("text_id").cast("int").alias("seq_id"), F.col("pos").cast("int").alias("nb"), "d")


def right_bounds(ranked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """lb, rb (closed; null where the column isn't valid), for every column."""
    m = ranked.select("seq_id").distinct().count()
    ends = ranked.where("ch <> '-'").select("seq_id", F.col("nb").alias("last"), F.col("col").alias("rb"))
    reached = prefixes.where("d IS NOT NULL").withColumn("last", F.col("nb") + F.col("d") - 1).join(ends.hint("merge"), ["seq_id", "last"])
    valid = reached.groupBy("col").agg(F.count("*").alias("n"), F.max("rb").alias("rb")).where(F.col("n") == m)
    return ranked.select("col").distinct().join(valid.hint("merge"), "col", "left").select(F.col("col").cast("bigint").alias("lb"), F.col("rb").cast("bigint").alias("rb"))


def find_block_boundaries(ranked: DataFrame, length: int = S.PIECE) -> DataFrame:
    """Raw segmentation."""
    return right_bounds(ranked, settle(unique_prefixes(ranked, length), "prefixes"))


def next_blocks(raw: DataFrame) -> DataFrame:
    """lb, rb (half-open), next_lb, next_rb: the block that a chain of most blocks takes next.

    Of the blocks that start at rb or later, the one that ends first, the latest start among
    equals: a running minimum from the right, in stretches.  Windows run backwards: a frame up
    to the last row would be gone through anew for each row.
    """
    half = raw.where("rb IS NOT NULL").select("lb", (F.col("rb") + 1).alias("rb"))
    best = F.struct("rb", (-F.col("lb")).alias("neg"))
    stretch = 4096
    cut = half.withColumn("s", F.floor(F.col("lb") / stretch))
    tails = cut.groupBy("s").agg(F.min(best).alias("b"))
    later = tails.select("s", F.min("b").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    inner = cut.select("s", "lb", "rb", F.min(best).over(Window.partitionBy("s").orderBy(F.desc("lb")).rowsBetween(Window.unboundedPreceding, 0)).alias("own"))
    suffix = inner.join(F.broadcast(later), "s").select("lb", "rb", F.least("own", F.coalesce("later", "own")).alias("best"))
    # the first start at or after rb: starts are dense in valid columns, so look it up through the next valid start
    marks = suffix.select(F.col("lb").alias("p"), F.lit(1).alias("kind"), "best").unionByName(suffix.select(F.col("rb").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("struct<rb:bigint,neg:bigint>").alias("best")).distinct())
    cutm = marks.withColumn("s", F.floor(F.col("p") / stretch))
    heads = cutm.where("kind = 1").groupBy("s").agg(F.min_by("best", "p").alias("h"))
    nexts = cutm.select("s").distinct().join(heads, "s", "left").select("s", F.last("h", True).over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)).alias("n"))
    filled = cutm.select("s", "p", "kind", F.last("best", True).over(Window.partitionBy("s").orderBy(F.desc("p"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)).alias("f"))
    look = filled.where("kind = 0").join(F.broadcast(nexts), "s").select(F.col("p").alias("rb"), F.coalesce("f", "n").alias("f"))
    return suffix.select("lb", "rb").join(look.hint("merge"), "rb").select("lb", "rb", (-F.col("f.neg")).alias("next_lb"), F.col("f.rb").alias("next_rb"))


def _in_stretch(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a stretch in order, where each leads (-1: nowhere), the place of that start in the stretch (-1: beyond it), and which ones are entered."""
    table = table.sort_by("a")
    a = table["a"].to_numpy()
    b = table["b"].fill_null(-1).to_numpy()
    at = np.searchsorted(a, b)
    inside = (at < len(a)) & (b >= 0)
    inside[inside] = a[at[inside]] == b[inside]
    return a, b, np.where(inside, at, -1), table["entered"].to_numpy(zero_copy_only=False)


def _way_out(table: pa.Table) -> pa.Table:
    a, b, at, _entered = _in_stretch(table)
    out, after = b.tolist(), at.tolist()
    for i in range(len(out) - 1, -1, -1):
        if after[i] >= 0:
            out[i] = out[after[i]]
    return pa.table([pa.array(a), pa.array([None if x < 0 else x for x in out], pa.int64())], ["a", "b"])


def _walk(table: pa.Table) -> pa.Table:
    a, b, at, entered = _in_stretch(table)
    rows = []
    for i in np.nonzero(entered)[0][:1].tolist():
        while i >= 0:
            rows.append((int(a[i]), None if b[i] < 0 else int(b[i]), len(rows)))
            i = int(at[i])
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["lb", "next", "k"])


def max_blocks(raw: DataFrame) -> DataFrame:
    """block_idx, lb, rb (half-open): a segmentation of most blocks; ties go to the earliest end, then the latest start.

    Each start leads to one next start.  Within stretches of columns, where each start leads
    out to is found in one pass backwards; the ways between stretches, few as they are, are
    followed from column 0 by pointer doubling; then each stretch lists its blocks.
    """
    n = raw.agg(F.max("lb")).first()[0]
    if n is None or raw.where("lb = 0 AND rb IS NOT NULL").isEmpty():
        raise ValueError("no segmentation: no block starts at column 0")
    return _chain(settle(next_blocks(raw).select(F.col("lb").alias("a"), F.col("next_lb").alias("b")), "jump"), n + 1)


def _chain(jump: DataFrame, total: int) -> DataFrame:
    """block_idx, lb, rb of the chain of starts from column 0 on, where each start a leads to b (null or no start: the end)."""
    stretch = F.floor(F.col("a") / STRETCH).alias("s")
    ways = settle(jump.select("a", "b", F.lit(False).alias("entered"), stretch).groupBy("s").applyInArrow(_way_out, "a bigint, b bigint"), "ways")
    entries = ways.select(F.col("b").alias("a")).where("a IS NOT NULL").distinct()
    hop = settle(ways.join(entries.unionByName(jump.where("a = 0").select("a")).distinct(), "a", "left_semi").where("b IS NOT NULL"), "hops")
    reached = settle(jump.where("a = 0").select("a"), "reached")
    while True:
        more = reached.join(hop, "a").select(F.col("b").alias("a"))
        if more.isEmpty():
            break
        reached = settle(reached.unionByName(more).distinct(), "reached")
        hop = settle(hop.join(hop.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "hops")
    marked = jump.join(reached.withColumn("e", F.lit(True)), "a", "left").select("a", "b", F.coalesce("e", F.lit(False)).alias("entered"), stretch)
    walked = settle(marked.groupBy("s").applyInArrow(_walk, "lb bigint, next bigint, k bigint").withColumn("s", F.floor(F.col("lb") / STRETCH)), "walked")
    # a row for each stretch
    base = walked.groupBy("s").agg(F.count("*").alias("c")).select("s", (F.sum("c").over(Window.orderBy("s")) - F.col("c")).alias("base"))
    return walked.join(F.broadcast(base), "s").select((F.col("base") + F.col("k")).cast("int").alias("block_idx"), "lb", F.coalesce("next", F.lit(total)).cast("bigint").alias("rb"))


def _good(a: list[int], e: list[int], base: int, border: int, right: np.ndarray | None, limit: int) -> tuple[list[int], list[int]]:
    """Starts ``a`` of columns [base, border) from which the rest can be cut in blocks of at most ``limit`` columns, and the next start of each.

    ``right``: the good starts of the next ``limit`` columns, in order (None: all of them are).
    The next start is the first good one at or after the least end ``e``.
    """
    size = border - base
    if right is None:
        beyond = list(range(border, border + limit + 1))
    else:
        at = np.searchsorted(right, np.arange(border, border + limit + 1))
        beyond = np.append(right, -1)[at].tolist()
    ahead = [-1] * size + beyond
    good, after = [], []
    k = len(a) - 1
    for c in range(size - 1, -1, -1):
        if k >= 0 and a[k] - base == c:
            if e[k] - a[k] <= limit and 0 <= (y := ahead[e[k] - base]) <= a[k] + limit:
                ahead[c] = a[k]
                good.append(a[k])
                after.append(y)
            else:
                ahead[c] = ahead[c + 1]
            k -= 1
        else:
            ahead[c] = ahead[c + 1]
    return good[::-1], after[::-1]


def _stretch_states(width: int, total: int, jumps: bool):
    """A function over a stretch's starts and the states that are known to its right: its own states for each limit asked; with ``jumps`` the next starts of its good ones.

    A state is the good starts of a stretch's first ``limit`` columns; null to the right: any column.
    """
    last = (total - 1) // width

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        s = key[0].as_py()
        left = left.drop_null().sort_by("a")
        a, e = left["a"].to_pylist(), left["e"].to_pylist()
        base, border = s * width, min(total, (s + 1) * width)
        rows = []
        for limit, state in zip(right["limit"].to_pylist(), right["state"].to_pylist(), strict=True):
            beyond = [total] if s == last else state
            good, after = _good(a, e, base, border, None if beyond is None else np.array(beyond, np.int64), limit)
            if jumps:
                rows += zip(good, after, strict=True)
            else:
                rows.append((s, limit, [x for x in [*good, *([total] if s == last else [])] if x < base + limit]))
        names, kinds = (["a", "b"], (pa.int64(), pa.int64())) if jumps else (["s", "limit", "state"], (pa.int64(), pa.int64(), pa.list_(pa.int64())))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run, "a bigint, b bigint" if jumps else "s bigint, `limit` bigint, state array<bigint>"


def _over_stretches(starts: DataFrame, asked: DataFrame, width: int, total: int, jumps: bool) -> DataFrame:
    """What each stretch that is asked says. Stretches are few bytes and much work: their parts are named, or else Spark puts them all into one."""
    parts = max(1, min((total - 1) // width + 1, int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own, asked = starts.repartition(parts, "s"), asked.repartition(parts, "s")
    run, schema = _stretch_states(width, total, jumps)
    return own.groupBy("s").cogroup(asked.groupBy("s")).applyInArrow(run, schema)


def _to_the_left(states: DataFrame) -> DataFrame:
    """What stretches are asked with: the states next to the right."""
    return states.where("s > 0").select((F.col("s") - 1).alias("s"), "limit", "state")


def _settled_states(starts: DataFrame, limits: list[int], width: int, total: int) -> tuple[set[int], set[int], DataFrame]:
    """Limits by which all columns can be cut, limits by which they can't, and the states (s, limit, state), which are certain for the former.

    At first each stretch takes every column to its right for good, and each further round takes
    the states of the round before, so states only shrink.  Where none has changed all are
    certain: that of the last stretch is, and so each one to its left.  A limit is out as soon as
    a stretch has nothing good, or column 0 isn't.  Only stretches whose state to the right has
    changed are looked at again, and only limits that the decided ones leave open.
    """
    last = (total - 1) // width
    asked = starts.sparkSession.range(last + 1).select(F.col("id").alias("s"), F.explode(F.lit(limits).cast("array<bigint>")).alias("limit"), F.lit(None).cast("array<bigint>").alias("state"))
    states, good, out, left = None, set(), set(), list(limits)
    while left:
        own = starts if states is None else starts.join(asked.select("s").distinct(), "s", "left_semi").select(starts.columns)
        new = _over_stretches(own, asked, width, total, jumps=False)
        if states is None:
            states = settle(new.withColumn("changed", F.lit(last > 0)), "states")
        else:
            both = states.drop("changed").join(new.withColumnRenamed("state", "now"), ["s", "limit"], "left")
            states = settle(both.select("s", "limit", F.coalesce("now", "state").alias("state"), (F.coalesce(F.size("now"), F.size("state")) < F.size("state")).alias("changed")), "states")
        lost = (F.size("state") == 0) | (F.col("s") == 0) & ~F.array_contains("state", F.lit(0))
        for r in states.where(F.col("limit").isin(left)).groupBy("limit").agg(F.max(lost).alias("lost"), F.max("changed").alias("changed")).collect():
            if r.lost or not r.changed:
                (out if r.lost else good).add(r.limit)
        left = [x for x in left if max(out, default=0) < x < min(good, default=x + 1)]
        asked = _to_the_left(states.where(F.col("changed") & F.col("limit").isin(left)))
    return good, out, states


def min_longest_blocks(raw: DataFrame, stretch: int = STRETCH, many: int = 16) -> DataFrame:
    """block_idx, lb, rb (half-open): a segmentation whose longest block is as short as possible; each block ends as early as that allows.

    The least length is searched with ``many`` lengths at a time: first powers of two, then
    between the last one that is too short and the first one that isn't.  A length is tried
    over stretches of columns, at least as wide as itself, that meet only in the good starts
    within it of a border: no task holds all columns unless a block has to be as long.
    """
    n = raw.agg(F.max("lb")).first()[0]
    if n is None:
        raise ValueError("no segmentation: no columns")
    total = n + 1

    def cut(width: int) -> DataFrame:
        own = raw.where("rb IS NOT NULL").select(F.col("lb").alias("a"), (F.col("rb") + 1).alias("e"), F.floor(F.col("lb") / width).alias("s"))
        # the last stretch has a row even where nothing starts in it
        return settle(own.unionByName(own.sparkSession.createDataFrame([((total - 1) // width,)], "s bigint").select(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("e"), "s")), "starts")

    width = stretch
    starts = cut(width)
    tried, hi = [1 << k for k in range(stretch.bit_length()) if 1 << k <= min(stretch, 2 * total)], None
    lo = 0
    while hi is None:
        good, out, states = _settled_states(starts, tried, width, total)
        hi, lo = min(good, default=None), max([lo, *out])
        if hi is None:
            if lo >= total:
                raise ValueError("no segmentation: no block starts at column 0")
            width = 2 * lo
            starts, tried = cut(width), [width]
    while hi - lo > 1:
        tried = sorted({lo + max(1, (hi - lo) * k // (many + 1)) for k in range(1, many + 1)} - {hi})
        good, out, more = _settled_states(starts, tried, width, total)
        states = more if min(good, default=hi) < hi else states
        hi, lo = min([hi, *good]), max([lo, *out])
    # each good start's next one, by the certain states
    known = states.where(F.col("limit") == hi)
    ends = known.where(F.col("s") == (total - 1) // width).select("s", "limit", F.lit(None).cast("array<bigint>").alias("state"))
    jump = _over_stretches(starts, _to_the_left(known).unionByName(ends), width, total, jumps=True)
    return _chain(settle(jump.where(F.col("b").isNotNull()), "jump"), total)


def min_longest_block(raw: DataFrame) -> DataFrame:
    """One row: min_max_len, the least longest block of any segmentation."""
    return min_longest_blocks(raw).agg(F.max(F.col("rb") - F.col("lb")).alias("min_max_len"))


def optimize(raw: DataFrame, objective: str) -> DataFrame:
    """block_idx, lb, rb for either objective."""
    return {"max-blocks": max_blocks, "min-longest": min_longest_blocks}[objective](raw)


def check_segmentation(seg: DataFrame, raw: DataFrame) -> DataFrame:
    """block_idx, lb, rb, ok: whether the block starts at a valid column and reaches its minimal right bound."""
    joined = seg.join(raw.select("lb", F.col("rb").alias("least")), "lb", "left")
    return joined.select("block_idx", "lb", "rb", F.coalesce(F.col("rb") >= F.col("least") + 1, F.lit(False)).alias("ok"))
