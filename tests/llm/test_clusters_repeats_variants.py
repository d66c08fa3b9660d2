"""Centroids, repeated passages and spelling variants against brute force, their statements, and awkward rows."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.llm import clusters, relative, variants
from colweave.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
WHITE = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, row string, word string, source string"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_substring_dedup", "op13_spelling_variants"])
def test_statement(spark, name, tmp_path):
    duck = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    QUERIES[name](spark, DIR).write.parquet(str(tmp_path / "q"))
    got, want = duck.sql(f"SELECT * FROM '{tmp_path}/q/*.parquet'").df(), duck.sql(ORACLES[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and len(got) and rows(got) == rows(want)


# --- centroids ---


@pytest.mark.parametrize("reach", [3, 1000, 1 << 40])
def test_nearest_is_exact(reach):
    r = np.random.default_rng(1)
    x, c = r.integers(-reach, reach, (300, 64)), r.integers(-reach, reach, (9, 64))
    c[4], x[:20] = c[2], c[r.integers(0, 9, 20)]  # equal centroids, and rows on them
    label, far = clusters.nearest(x, c)
    for k in range(len(x)):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[k], y, strict=True)) for y in c]
        assert int(far[k]) == min(d) and label[k] == d.index(min(d))


def _cluster_by_hand(rows, count, rounds):
    kept = [(i, [int(np.floor(1024.0 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:count]
    cents = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            own = [v for (_, v), z in zip(kept, label, strict=True) if z == k]
            cents[k] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else cents[k]
    out = [(i, *near(v)) for i, v in kept]
    total = lambda k: sum(d for _, d, z in out if k is None or z == k)
    return sorted((str(i), k, d, total(k), total(None), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in out)


def test_centroids_of_awkward_rows(spark):
    r = random.Random(5)
    v = lambda: [r.uniform(-1, 1) for _ in range(64)]
    same = v()
    rows = [(i, v()) for i in range(60)] + [(7, v()), (61, same), (61, same), (62, same), (None, v()), (70, None), (71, []), (72, [0.5] * 63), (73, [0.5] * 63 + [None]), (74, [0.5] * 63 + [float("nan")]), (75, [float("inf")] + [0.5] * 63), (76, [0.0] * 64)]
    df = spark.createDataFrame([(i, x, 9, "c") for i, x in rows], "vec_id bigint, embedding array<float>, cluster int, v string")
    got = clusters.cluster(df.repartition(3), count=8, rounds=4).collect()
    assert sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in got) == _cluster_by_hand(rows, 8, 4)


def test_centroids_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema), rounds=2).collect() == []
    assert clusters.cluster(spark.createDataFrame([(None, [0.5] * 64)], schema), rounds=2).collect() == []
    two = clusters.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], schema), rounds=2).collect()
    assert [(x.vec_id, x.cluster, x.distance, x.inertia) for x in sorted(two)] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    # beyond a long: the largest long, and no overflow of sums
    far = clusters.cluster(spark.createDataFrame([(k, [s * 3e38] * 64) for k, s in enumerate((1, -1, 1, -1))], schema), count=1, rounds=1).collect()
    assert {x.inertia for x in far} == {(1 << 63) - 1} and len(far) == 4


# --- repeated passages ---


def _strip_by_hand(rows, window):
    words = [WHITE.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out), words


def _passages(seed, count, letters, window):
    """Documents of passages that many share, cut at all places, with few different words."""
    r = random.Random(seed)
    word = lambda: r.choice(letters)
    shared = [[word() for _ in range(r.randint(window - 2, 4 * window))] for _ in range(6)] + [[word()] * (3 * window)]
    rows = []
    for i in range(count):
        w = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a, z = sorted((r.randint(0, len(s)), r.randint(0, len(s)))) if r.random() < 0.5 else (0, len(s))
            w += s[a:z] + [word() for _ in range(r.choice([0, 0, 1, 9]))]
        rows.append((i * 3 % count if count % 3 else i, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "letters", "window"), [(1, "ab", 8), (2, "abcdefgh", 10), (3, ["a", "é", "日本", "\x1c", "\xa0x"], 6), (4, [f"w{k}" for k in range(200)], 50), (5, "a", 6)])
def test_repeats_are_exact(spark, seed, letters, window):
    rows = _passages(seed, 70, letters, window)
    rows += [(None, rows[0][1]), (None, None), (3, rows[5][1]), (3, rows[5][1]), rows[7], rows[7], (500, ""), (501, None), (502, " \n"), (-4, rows[9][1])]
    df = spark.createDataFrame([(d, t, "r", "w", "s") for d, t in rows], DOCS).repartition(5)
    want, words = _strip_by_hand(rows, window)
    got = relative.strip_repeats(df, window=window).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == want
    assert any(n for _, _, n, _ in want)
    texts: dict = {}
    for (d, _), w in zip(rows, words, strict=True):
        texts.setdefault(d, []).append(w)
    for x in got:  # factors are disjoint and in order, and some text of their source holds their words
        assert hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256
        assert sum(f.end - f.start for f in x.factors) == x.n_removed
        assert all(a.end <= b.start for a, b in zip(x.factors, x.factors[1:], strict=False))
        for f in x.factors:
            own = {tuple(w[f.start : f.end]) for w in texts[x.doc_id] if len(w) == x.n_words}
            assert f.source < x.doc_id and any(tuple(w[f.source_start : f.source_start + f.end - f.start]) in own for w in texts[f.source])


def test_repeats_in_slices(spark, monkeypatch):
    """Long texts in slices of bytes and of windows give the same rows."""
    r = random.Random(8)
    passage = [f"p{r.randint(0, 50)}" for _ in range(900)]
    noise = lambda n: [f"n{r.randint(0, 10**6)}" for _ in range(n)]
    rows = [(k, " ".join(noise(700) + passage[k * 50 :] + noise(300) + passage[: 500 + k] + ["x" * 5000])) for k in range(5)]
    monkeypatch.setattr(relative, "BYTES", 999)
    assert [sum(map(len, relative.word_slices(t))) for _, t in rows] == [len(t.split()) for _, t in rows]
    monkeypatch.setattr(relative, "SLICE", 64)
    for _, t in rows:
        h = relative.word_hashes(t)
        parts = list(relative.blocks_of(h, 50))
        lo, hi = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        assert lo[0] == 0 and hi[-1] == len(h) - 50 and (lo[1:] == hi[:-1] + 1).all()
    monkeypatch.undo()
    got = relative.strip_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == _strip_by_hand(rows, 50)[0]


def test_factors_are_greedy():
    assert relative.factored([]) == []
    assert relative.factored([(0, 10, 1, 5), (4, 20, 2, 0), (10, 14, 1, 15), (30, 40, 1, 0), (12, 18, 1, 17)]) == [(0, 18, 1, 5), (18, 20, 2, 14), (30, 40, 1, 0)]


def test_a_block_is_chosen_by_its_words_only():
    r = np.random.default_rng(4)
    passage = r.integers(0, 2**63, 200).astype(np.uint64)
    at = lambda n: np.concatenate([r.integers(0, 2**63, n).astype(np.uint64), passage])
    keys = [{(int(a), int(c)) for part in relative.blocks_of(at(n), 50) for a, c in zip(part[2], part[3], strict=True)} for n in (0, 1, 77)]
    assert len(keys[0] & keys[1] & keys[2]) >= len(keys[0]) - 3
    with_ties = np.array([5, 3, 3, 4, 3, 9], np.uint64)
    assert relative._anchors(with_ties, 3).tolist() == [1, 1, 2, 4]


# --- spelling variants ---


def _variants_by_hand(rows, every=199, least_letters=6, least=5, ratio=5):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_letters and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, []
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = (best if best and n[best] >= ratio * n[w] else None, len(others))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n[w], form[w][1], n[f] if f else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [4, 20_000])
def test_variants_are_exact(spark, monkeypatch, shard):
    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "ÀÉÎÕÜ÷"]
    rows = [(k, " ".join(r.choice([w, w.upper(), w.title()]) for w in r.choices(base, [1 + 3 ** (i % 6) for i in range(len(base))], k=120)) + ",x1 tiny") for k in range(60)]
    rows += [(None, "aaaaaa aaaaab"), (None, None), (3, ""), (4, "aaaaab " * 40), (4, "aaaaab " * 40), (5, "q" * 3000)]
    rows += [(k, "kettlers " * n + "kettlersy " * (8 * n) + "kettlersyx " * (60 * n)) for k, n in ((90, 5), (91, 6), (92, 7))]
    monkeypatch.setattr(variants, "SHARD", shard)
    df = spark.createDataFrame([(d, t, "r", "w", "s") for d, t in rows], DOCS).repartition(3)
    got = variants.variants(df, every=11)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _variants_by_hand(rows, every=11)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(x[1] and x[2] != x[1] for x in want)  # a form that has a form


def test_variants_of_no_rows(spark):
    for rows in ([], [(1, None), (2, ""), (3, "one two")]):
        assert variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() == []


def test_one_apart():
    yes = [("abc", "abd"), ("abc", "ab"), ("abc", "bc"), ("abc", "ac"), ("aab", "ab"), ("abc", "xabc"), ("abc", "abcx"), ("abc", "abxc")]
    no = [("abc", "abc"), ("abc", "acb"), ("abc", "a"), ("abc", "abcde"), ("abc", "xbd"), ("ab", "bac")]
    assert all(variants.one_apart(a, b) and variants.one_apart(b, a) for a, b in yes)
    assert not any(variants.one_apart(a, b) or variants.one_apart(b, a) for a, b in no)
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(n)) for n in (6, 7) for _ in range(300)})
    for size in (6, 7):
        held = [w for w in words if len(w) == size]
        shard = variants.Halves(held)
        for w in words:
            if len(w) in (size, size - 1):
                assert {held[k] for k in shard.near(w)} == {x for x in held if variants.one_apart(w, x)}


def test_runs_in_slices(monkeypatch):
    text = "Über straße ÷x foo-bar " * 50 + "q" * 300 + " Ünd"
    want = [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(variants, "BYTES", size)
        assert [w for part in variants._runs(text) for w in part] == want
