"""The tree of a suffix order: intervals of ranks whose suffixes share a prefix.

A node is an interval [lb, rb] of ranks with a depth: all its suffixes share ``depth``
characters, some neighbours in it share no more, and the suffixes next to it share less.  The
node of a rank i > 0 is the one around i whose depth is lcp[i]: it starts at the last rank
before i that shares less with the one before itself, and ends before the next such rank.

These nearest smaller values are found stretch by stretch.  What a stretch can't answer are
questions about its running minima from either end; these few go on, with its minima as
answers to the questions of others, and meet in groups of ``FAN`` stretches, then in groups of
groups, until all are answered.  No task holds more than a stretch or the minima of a group.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.scratch import settle

#: Ranks of a stretch; stretches, or groups of them, that meet in one task.
STRETCH, FAN = 65_536, 256

# kind: '' a rank with what its stretch tells; '<' and '>' minima that answer questions from later and earlier
# stretches; 'before' and 'after' open questions of stretch q about the value v; 'was' and 'will' their answers
_SCHEMA = "kind string, s bigint, q bigint, idx bigint, v int, lb bigint, nb bigint, first boolean"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
_NAMES = ["kind", "s", "q", "idx", "v", "lb", "nb", "first"]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], _NAMES)


def _in_stretch(table: pa.Table) -> pa.Table:
    table = table.sort_by("idx")
    idx, v, s = table["idx"].to_pylist(), table["v"].to_pylist(), table["s"][0].as_py()
    n = len(idx)
    lb, nb, first = [None] * n, [None] * n, [True] * n
    before: list[int] = []  # places of rising values, of equal ones the last
    for k in range(n):
        while before and v[before[-1]] > v[k]:
            before.pop()
        if before and v[before[-1]] == v[k]:
            lb[k], first[k] = lb[before.pop()], False
        elif before:
            lb[k] = idx[before[-1]]
        before.append(k)
    after: list[int] = []  # the same from the right, of equal ones the first
    for k in reversed(range(n)):
        while after and v[after[-1]] > v[k]:
            after.pop()
        if after and v[after[-1]] == v[k]:
            nb[k] = nb[after.pop()]
        elif after:
            nb[k] = idx[after[-1]]
        after.append(k)
    rows = list(zip([""] * n, [s] * n, [s] * n, idx, v, lb, nb, first, strict=True))
    rows += [("<", s, s, idx[k], v[k], None, None, None) for k in before] + [(">", s, s, idx[k], v[k], None, None, None) for k in after]
    for kind, found in (("before", lb), ("after", nb)):
        rows += [(kind, s, s, None, x, None, None, False) for x in {v[k] for k in range(n) if found[k] is None}]
    return _table(rows)


def _meeting(fan: int):
    """A function that answers within one group of ``fan`` stretches, and passes on the rest as one stretch of the next level."""

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(_NAMES).to_pylist(), key=lambda r: (r["s"], r["idx"] or 0))
        group = rows[0]["s"] // fan
        out: list[tuple] = []
        for minima, question, answer, order in (("<", "before", "was", 1), (">", "after", "will", -1)):
            values: list[int] = []
            places: list[int] = []
            held: list[dict] = []
            for r in [*rows[::order], None]:
                # minima of a stretch answer the stretches behind it, not its own
                if held and (r is None or r["s"] != held[0]["s"]):
                    for m in held:
                        while values and values[-1] >= m["v"]:
                            values.pop()
                            places.pop()
                        values.append(m["v"])
                        places.append(m["idx"])
                    held = []
                if r is None:
                    break
                if r["kind"] == minima:
                    held.append(r)
                elif r["kind"] == question:
                    k = bisect_left(values, r["v"])
                    equal = r["first"] or (k < len(values) and values[k] == r["v"])
                    out.append((answer if k else question, group, r["q"], places[k - 1] if k else None, r["v"], None, None, equal))
            out += [(minima, group, group, i, v, None, None, None) for i, v in zip(places, values, strict=True)]
        return _table(out)

    return meet


def surroundings(order: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """idx, lcp (-1 at rank 0), lb, nb, first: of each rank's node the first rank, the rank after the last, and whether no rank before has this node."""
    own = order.select("idx", F.when(F.col("idx") == 0, -1).otherwise(F.col("lcp")).cast("int").alias("v"), F.floor(F.col("idx") / stretch).alias("s"))
    now = settle(own.groupBy("s").applyInArrow(_in_stretch, _SCHEMA), "stretches")
    ranks = now.where("kind = ''")
    size = order.agg(F.count("*")).first()[0]
    open_, answers = now.where("kind <> ''"), []
    parts = -(-size // stretch)
    while parts > 1 and not open_.where("kind IN ('before', 'after')").isEmpty():
        met = settle(open_.groupBy(F.floor(F.col("s") / fan)).applyInArrow(_meeting(fan), _SCHEMA), "met")
        answers.append(met.where("kind IN ('was', 'will')"))
        open_, parts = met.where("kind NOT IN ('was', 'will')"), -(-parts // fan)
    done = ranks.where("lb IS NOT NULL AND nb IS NOT NULL").select("idx", F.col("v").alias("lcp"), "lb", "nb", "first")
    rest = ranks.where("lb IS NULL OR nb IS NULL")
    for k, (kind, column) in enumerate((("was", "lb"), ("will", "nb"))):
        found = None
        for a in answers:
            found = a if found is None else found.unionByName(a)
        if found is None:
            continue
        known = found.where(F.col("kind") == kind).select(F.col("q").alias("s"), "v", F.col("idx").alias("at"), F.col("first").alias("equal"))
        asked = rest.where(F.col(column).isNull()).drop(column).join(known.hint("merge"), ["s", "v"], "left").withColumn(column, F.col("at"))
        asked = asked.withColumn("first", F.col("first") & ~F.coalesce("equal", F.lit(False))) if k == 0 else asked
        rest = rest.where(F.col(column).isNotNull()).unionByName(asked.drop("at", "equal"))
    # nothing shares less after the last such rank
    return settle(done.unionByName(rest.select("idx", F.col("v").alias("lcp"), "lb", F.coalesce("nb", F.lit(size)).alias("nb"), "first")), "surroundings")


def parents(intervals: DataFrame, around: DataFrame) -> DataFrame:
    """``intervals`` (lb, rb; nodes or single ranks) with parent_lb, parent_rb, parent_depth; null at the root."""
    left = around.select(F.col("idx").alias("lb"), F.col("lcp").alias("__a"), F.col("lb").alias("__lb"))
    right = around.select((F.col("idx") - 1).alias("rb"), F.col("lcp").alias("__b"), (F.col("nb") - 1).alias("__rb"))
    # tables of ranks are small as files, not in memory: none is broadcast
    both = intervals.hint("merge").join(left, "lb").hint("merge").join(right.hint("merge"), "rb", "left").withColumn("__b", F.coalesce("__b", F.lit(-1)))
    depth = F.greatest("__a", "__b")
    up = lambda c: F.when(depth >= 0, c)
    return both.select(
        *intervals.columns,
        up(F.when(F.col("__a") == depth, F.col("__lb")).otherwise(F.col("lb"))).alias("parent_lb"),
        up(F.when(F.col("__b") == depth, F.col("__rb")).otherwise(F.col("rb"))).alias("parent_rb"),
        up(depth).alias("parent_depth"),
    )


def suffix_tree(order: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """lb, rb, depth, parent_lb, parent_rb, parent_depth of every inner node."""
    around = surroundings(order) if around is None else around
    return parents(around.where("first AND idx > 0").select("lb", (F.col("nb") - 1).alias("rb"), F.col("lcp").alias("depth")), around)


def leaves(order: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """text_id, pos, idx, parent_lb, parent_rb, parent_depth of every suffix."""
    around = surroundings(order) if around is None else around
    own = order.select("text_id", "pos", "idx", F.col("idx").alias("lb"), F.col("idx").alias("rb"))
    return parents(own, around).drop("lb", "rb")
