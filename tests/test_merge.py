"""Orders of collections that grow: equal to fresh ones after each addition, with most stored suffixes untouched."""

import random

import pytest
from pyspark.sql import functions as F

from colweave.functions.order import running_max
from colweave.operators import merge as M
from colweave.operators import suffixes as S
from colweave.plans import index as P

PARTS = [
    [(0, "banana"), (1, "bandana"), (2, ""), (3, "ab" * 40 + "c")],
    [(10, "banana"), (11, "zzz"), (12, None), (4, "ab" * 40 + "d" + "ab" * 9)],
    [(5, "a"), (6, "é$ban")],
    [(7, "ananas"), (8, "ab" * 40 + "c"), (9, "z")],
]


def _texts(spark, rows):
    return spark.createDataFrame(rows, "text_id bigint, s string")


def _rows(order):
    return [tuple(r) for r in order.select("idx", "text_id", "pos", "lcp", "ch").orderBy("idx").collect()]


def _by_definition(rows):
    every = sorted((s[p:], i, p, s[p - 1] if p else "$") for i, s in rows for p in range(len(s or "")))

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    return [(n, i, p, shared(every[n - 1][0], t) if n else 0, c) for n, (t, i, p, c) in enumerate(every)]


@pytest.mark.parametrize("width", [3, None])
def test_three_additions(spark, tmp_path, width):
    known, folder = PARTS[0], str(tmp_path / "0")
    P.save_suffix_order(S.suffix_order(_texts(spark, known)), folder, _texts(spark, known))
    for n, more in enumerate(PARTS[1:], 1):
        stored = P.suffix_order_of(_texts(spark, known), folder)
        out = M.extended_order(stored, _texts(spark, known), _texts(spark, more), width=width)
        known, folder = known + more, str(tmp_path / str(n))
        P.save_suffix_order(out, folder, _texts(spark, known))
        assert _rows(spark.read.parquet(f"{folder}/order")) == _by_definition(known)


def test_most_stretches_stay_closed(spark, monkeypatch):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abcd") for _ in range(100))) for i in range(30)]
    more = [(100, "abca"), (101, "dd")]
    stored = S.suffix_order(_texts(spark, texts)).cache()
    sorted_rows, plain = [], M.order_among

    def counted(suffixes, *rest):
        sorted_rows.append(suffixes.count())
        return plain(suffixes, *rest)

    monkeypatch.setattr(M, "order_among", counted)
    out = M.extended_order(stored, _texts(spark, texts), _texts(spark, more), width=20)
    assert _rows(out) == _by_definition(texts + more)
    # six added suffixes, 150 heads, six opened stretches at most
    assert sorted_rows[0] == 156 and sorted_rows[1] <= 156 + 6 * 19


def test_nothing_stored_or_added(spark, tmp_path):
    some, none = _texts(spark, PARTS[0]), _texts(spark, [])
    stored = S.suffix_order(some).cache()
    assert _rows(M.extended_order(stored, some, none)) == _rows(stored)
    assert _rows(M.extended_order(S.suffix_order(none), none, some)) == _rows(stored)
    with pytest.raises(ValueError, match="has the id"):
        M.extended_order(stored, some, _texts(spark, [(3, "x")]))
    P.save_suffix_order(stored, str(tmp_path / "a"), some)
    with pytest.raises(ValueError, match="other texts"):
        P.extend_suffix_order(_texts(spark, [(1, "xyz")]), none, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="written over"):
        P.extend_suffix_order(some, none, str(tmp_path / "a"), str(tmp_path / "a"))
    again = P.extend_suffix_order(some, _texts(spark, [(77, "nab")]), str(tmp_path / "a"), str(tmp_path / "b"))
    assert _rows(again) == _by_definition([*PARTS[0], (77, "nab")])


def test_running_max(spark):
    values = [None, 3, None, 1, 7, None, 2, 9]
    rows = spark.createDataFrame(list(enumerate(values)), "at bigint, v int")
    got = [r.m for r in running_max(rows, "at", {"m": "v"}, stretch=3).orderBy("at").collect()]
    assert got == [max((v for v in values[:k] if v is not None), default=None) for k in range(len(values))]
