"""Each operator against brute force or an exact round trip, and on awkward rows."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colweave.llm import components, decontaminate, langid, licenses, mixing, quality, simhash, similar, spans, token_counts, token_shards, topk, toxicity
from colweave.llm.store import fold

AWKWARD = [None, "", " ", "\n\t ", "a", "A. ", "word " * 5000, "x" * 3000, "same text", "same text", "é ñ ß", "<|endoftext|>", "the MIT License", "日本語 テキスト"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", 0, t) for i, t in enumerate(AWKWARD)] + [(None, "no id", None, None, None, "score"), (3, "again", "en", "s", 5, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")


@pytest.fixture(scope="module")
def no_docs(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (5, 0, 1), (8, 0, 0), (8, 0, 0), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")


def test_token_counts_are_exact():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    r = random.Random(1)
    bits = ["a", "th", "the", "er", " ", "  ", "\n", "'s", "'ll", "'", "!", "1", "é", "<|endoftext|>", "<|end", "\t", "日", "...", "🙂", "\xa0", "\x1c", "re"]
    for _ in range(300):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        each = [count(s[:k]) for k in range(len(s) + 1)]
        assert own.count(s) == each[-1]
        assert own.by_char(s) == each
        for limit in (0, 2, 5):
            assert own.fitting(s, limit) == max(k for k, n in enumerate(each) if n <= limit)


@pytest.mark.parametrize("text", [" " * 200_000, "a" + "\n" * 100_000 + " b" + "\t \u2003" * 20_000 + "<|endoftext|>" * 40, "=" * 50_000])
def test_token_counts_of_long_runs(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    start = time.time()
    d = own.deltas(text)
    assert time.time() - start < 10
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(d, "<i2"), dtype=np.int64)])
    assert len(counts) == len(text) + 1
    for k in (1, 2, 99, 1000, 30_000, len(text) - 1, len(text)):
        assert counts[k] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_token_counts_query(spark, awkward, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(awkward, path, limit=3).withColumn("two", token_counts.longest_prefix("prefix_deltas", F.lit(2))).withColumn("prefix_tokens", token_counts.prefix_tokens("prefix_deltas")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect())
    assert all(r.over_limit == (r.n_tokens > 3) and r.prefix_tokens[-1] == r.n_tokens and r.prefix_tokens[r.two] <= 2 for r in got)
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_shards_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(r.random(n) < 0.05, r.integers(0, 2**32, n), r.integers(100, 900, n)).astype(np.uint32)
        s = token_shards.Shard(token_shards.pack(ids, np.array([n], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.uint8)))
        assert (s.ids() == ids).all()
        for lo, hi in ((0, 1), (100, 300), (4000, 6000)):
            assert (s.ids(lo, hi) == ids[lo:hi]).all()


def test_shards_query(spark, awkward, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_shards.token_shards(awkward, path).orderBy("start").collect()
    rows = awkward.collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(e := library.encode(r.text or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(e, "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert token_shards.token_shards(no_docs, path).count() == 0


@pytest.mark.parametrize(("bits", "segments", "bucket"), [(2, 2, 48), (2, 2, 1), (3, 2, 1), (4, 3, 2)])
def test_links_connect_exactly(spark, bits, segments, bucket):
    r = random.Random(bits)
    seeds = [r.getrandbits(64) for _ in range(8)]
    fps = sorted({s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for s in seeds for _ in range(12)} | {0})
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    got = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), bits, segments, bucket)).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    linked = {r.node: r.component for r in got}
    assert {f: linked.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_near_duplicates(spark, awkward, no_docs):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    blank = {r.component_id for r in got if r.fp == 0 and r.doc_id is not None}
    assert blank == {0}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_similar(texts, size=5, least=0.8):
    """Texts' component (least place), by comparing all of them."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b and not a or len(a & b) >= least * len(a | b) and a & b:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket", [48, 2])
def test_similar_groups(spark, bucket):
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(900)] + ["the", "of", "and"] * 90
    texts = [None, "", " ", "one two", "ONE  two", "two one", "one"]
    for size in (40, 120, 300):
        for _ in range(10):
            base = [r.choice(vocabulary) for _ in range(size)]
            for _ in range(r.choice((1, 3, 9))):
                w = list(base)
                for _ in range(r.randint(0, size // 25)):
                    w[r.randrange(size)] = r.choice(vocabulary)
                texts.append(" ".join(w))
    # equal words in other orders
    few = [r.choice(vocabulary) for _ in range(30)]
    texts += [" ".join(few), " ".join(few[::-1]), " ".join(few[::-1]).upper(), " ".join(few[15:] + few[:15])]
    texts += [texts[20], texts[20]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {x.doc_id: x.component for x in similar.similar_groups(docs, bucket=bucket).collect()}
    want = brute_similar(texts)
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    linked = sum(1 for i in range(len(texts)) for j in range(i) if want[i] == want[j])
    met = sum(1 for i in range(len(texts)) for j in range(i) if want[i] == want[j] and got[i] == got[j])
    assert len(got) == len(texts) and met >= 0.97 * linked
    assert not [(i, j) for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_wide_fingerprint():
    import xxhash

    for t in ("", "a", "The cat the CAT sat", "x y z " * 9):
        words = {w.lower() for w in t.split()}
        hashes = [int.from_bytes(xxhash.xxh3_128_digest(w.encode()), "little") for w in words]
        bits = [sum(h >> i & 1 for h in hashes) * 2 > len(hashes) for i in range(128)]
        want = tuple(sum(1 << i for i in range(63) if bits[at + i]) for at in (0, 64))
        assert similar.wide_fingerprint(similar.words_of(t)) == want


def test_parities_bound_what_differs():
    r = random.Random(8)
    vocabulary = [b"w%d" % i for i in range(300)]
    for n in (0, 1, 4, 5, 60, 400, 5000):
        a = [r.choice(vocabulary) for _ in range(n)]
        for changes in (0, 1, n // 20, n // 3):
            b = list(a)
            for _ in range(min(changes, n)):
                b[r.randrange(n)] = r.choice(vocabulary)
            x, y = (similar.shingle_set(w, 5) for w in (a, b))
            exact = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b)]
            assert [len(x), len(y)] == [len(e) for e in exact]
            differ = len(exact[0] ^ exact[1])
            assert len(np.setxor1d(x, y)) == differ
            bits = sum((p ^ q).bit_count() for p, q in zip(*([v % (1 << 64) for v in similar.parities(s)] for s in (x, y)), strict=True))
            assert bits <= differ and bits % 2 == differ % 2
            assert bits >= differ // 2 or differ > 128


@pytest.mark.parametrize("words", [1, 3])
def test_fingerprint_is_the_majority_of_bits(words):
    import xxhash

    r = random.Random(words)
    for n in (0, 1, 2, 3, 4, 50):
        w = [r.choice(["A", "bb", "ç", "dd!"]) for _ in range(n)]
        shingles = [" ".join(w[i : i + words]) for i in range(max(1, n - words + 1))] if n else []
        hashes = [xxhash.xxh64_intdigest(s.replace("A", "a").encode(), 42) for s in shingles]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if n else 0
        assert simhash.fingerprint("\t" + "  ".join(w) + "\n", words) == want


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=6) / 3]) for i in range(300)] + [(7, rows_same) for rows_same in [[0.5] * 6]] + [(301, [0.5] * 6), (350, [0.5] * 6), (400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (405, [1.0, 2.0]), (None, [0.1] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for i, x in ok if i != q)[:5]
            assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_cross_parse_is_greedy_longest_match():
    sample = {"x": ["abracadabra abra"], "y": ["the theme of that"]}
    p = langid.Parser(sample)
    for text in ("abra cad", "theft", "zzz", "that abracadabra", "a"):
        s = p.alphabet.symbols(text).tolist()
        for k, name in enumerate(p.languages):
            train = bytes(np.concatenate([p.alphabet.symbols(f"\n{t}\n") for t in sample[name]]).tolist())
            n = i = 0
            while i < len(s):
                j = 1
                while i + j < len(s) and bytes(s[i : i + j + 1]) in train:
                    j += 1
                n, i = n + 1, i + j
            assert np.isclose(p.costs([text])[0, k], n * p.bits[k] / len(s))
    assert np.isnan(p.costs([None, "", "123 !"])).all()


def test_languages(spark, awkward, no_docs):
    rows = [(i, t, x) for i in range(40) for x, t in (("en", "the house that is on the hill over there"), ("de", "das haus das auf dem berg steht und nicht dort"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.learn_languages(docs, fold(F.col("doc_id"), 5) != 0)
    got = {r.text: r for r in langid.score_languages(spark.createDataFrame([(1, "there is the hill", "there is the hill"), (2, "nicht auf dem berg", "nicht auf dem berg"), (3, "12 !", "12 !")], "doc_id int, t string, text string"), sample, text_col="t", keep=("text",)).collect()}
    assert [got[t].lang_pred for t in ("there is the hill", "nicht auf dem berg", "12 !")] == ["en", "de", "und"]
    scored = langid.score_languages(awkward, sample).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 for r in scored)
    assert langid.learn_languages(no_docs, F.lit(True)) == {}
    assert {r.lang_pred for r in langid.score_languages(awkward, {}).collect()} == {"und"}


def test_languages_of_models_in_turn(spark):
    """Workers are reused; each call scores with its own model."""
    texts = spark.createDataFrame([(1, "the hill is over there"), (2, "der berg ist dort")], "doc_id int, text string")
    models = [{"en": ["the hill is over there"], "de": ["der berg ist dort"]}, {"x": ["the hill"], "y": ["berg dort"]}, {}]
    for turn in range(20):
        m = models[turn % 3]
        got = {r.lang_pred for r in langid.score_languages(texts, m).collect()}
        assert got == (set(m) or {"und"})


def test_languages_of_long_texts_only(spark):
    rows = [(i, "the house on the hill " * 400, "en") for i in range(9)] + [(20 + i, "das haus auf dem berg", "de") for i in range(9)]
    sample = langid.learn_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert set(sample) == {"de", "en"} and all(len(t) <= langid.SAMPLE_SYMBOLS for x in sample.values() for t in x)


def test_spans_hash_alike_anywhere():
    a, b = "The cat, the CAT!! sat 42", "zz " * 50 + "the cat"
    t = next(spans.windows([a, b, None, ""]))
    word = lambda k: t.data[t.at[k] : t.end[k]].tobytes().decode().lower()
    by = {}
    for k in range(len(t)):
        by.setdefault(word(k), set()).add(int(t.hash[k]))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    long = "word " * 400_000
    assert sum(len(w) for w in spans.windows([long])) == 400_000


def test_windows_of_long_texts():
    r = random.Random(13)
    text = " ".join(r.choice(["cat", "dog!", "42", "###", "ñu"]) for _ in range(400_000))
    whole = [w for t in spans.windows([text]) for w in t.hash.tolist()]
    for overlap, words in ((2, False), (50, True)):
        parts = list(spans.windows(["a b", text, "c"], overlap=overlap, words=words))
        assert sum(len(t) - t.again for t in parts) == len(whole) + 3
        assert [w for t in parts[1:-1] for w in t.hash[t.again :].tolist()] == whole
        before = 0
        for t in parts[1:-1]:
            kinds = t.kind[t.again :] != spans.SIGN
            assert t.words_before == before - int((t.kind[: t.again] != spans.SIGN).sum())
            before += int(kinds.sum())
    few = [quality.dot([text[: spans.WINDOW - 10]], np.arange(1 << quality.BITS, dtype=np.float32))]
    at = [x for t in spans.windows([text], overlap=2) for x in quality.features(t)[0].tolist()]
    assert few and len(at) == 3 * len(whole) - 3


def test_quality(spark, awkward, no_docs, labels):
    r = random.Random(3)
    rows = [(i, (" ".join(r.choice(["the", "cat", "sat", "mat", "on"]) for _ in range(30)) if i % 3 else " ".join(r.choice(["x###", "y$$$", "z%%%"]) for _ in range(30)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = quality.quality(docs, marks, fold(F.col("doc_id"), 5) == 0).collect()
    held = [x for x in got if x.held_out]
    assert held and np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.95
    assert quality.quality(awkward, labels, fold(F.col("doc_id"), 5) == 0).count() == awkward.count()
    assert {x.score for x in quality.quality(awkward, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert quality.quality(no_docs, labels, F.lit(False)).count() == 0


def test_maximal_segments():
    def brute(s):
        """By definition: the best segment, then the rest on either side of it."""
        best = max(((sum(s[a:b]), -(b - a), -a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return brute(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute(s[b:])]

    r = random.Random(5)
    for _ in range(300):
        s = [r.choice([-3, -2, -1, 1, 2, 3]) + r.random() / 7 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s, float))] == brute(s)


def test_toxic_odds_and_calibration(spark):
    """Log-odds under the Dirichlet prior, lambda and K, each by its definition."""
    import math
    from collections import Counter

    r = random.Random(15)
    docs = []
    for _ in range(2500):
        y = int(r.random() < 0.3)
        docs.append((" ".join(r.choice(["cat", "sat", "mat", "hut"] * 4 + ["vile", "scum"] * (1 + 12 * y)) for _ in range(r.randint(5, 30))), y, 0))
    sample = spark.createDataFrame(docs, "text string, y int, part int")
    m = toxicity._fitted(toxicity._counts(sample))
    toxic, clean = (Counter(w for t, y, _ in docs if y == k for w in t.split()) for k in (1, 0))
    nt, nc = sum(toxic.values()), sum(clean.values())
    hashes = {w: int(next(spans.windows([w])).hash[0]) for w in set(toxic) | set(clean)}
    want = {}
    for w, h in hashes.items():
        a = toxicity.PRIOR * (toxic[w] + clean[w]) / (nt + nc)
        odds = math.log((toxic[w] + a) / (nt + toxicity.PRIOR - toxic[w] - a)) - math.log((clean[w] + a) / (nc + toxicity.PRIOR - clean[w] - a))
        z = odds / math.sqrt(1 / (toxic[w] + a) + 1 / (clean[w] + a))
        if abs(z) >= toxicity.LEAST_Z:
            want[h] = max(odds * min(1, abs(z) / toxicity.FULL_Z), -1.0)
    assert want and dict(zip(m.keys.tolist(), m.odds.tolist(), strict=True)) == pytest.approx(want)
    mass = {h: clean[w] / nc for w, h in hashes.items() if h in want}
    total = sum(p * math.exp(m.lam * (want[h] - toxicity.DRIFT)) for h, p in mass.items()) + (1 - sum(mass.values())) * math.exp(-m.lam * toxicity.DRIFT)
    assert total == pytest.approx(1, abs=1e-6)
    # K: the likelihood of best scores, and of texts without a segment, is greatest there
    gen = np.random.default_rng(1)
    sizes = gen.integers(50, 500, 4000)
    best = np.maximum(0, np.log(0.02 * sizes / gen.exponential(size=4000)) / 1.7)
    k = toxicity.tail_constant(best, sizes, np.full(4000, 1.7))
    like = lambda k: np.where(best > 0, np.log(k) - k * sizes * np.exp(-1.7 * best), -k * sizes).sum()
    assert abs(k / 0.02 - 1) < 0.1 and like(k) > max(like(0.97 * k), like(1.03 * k))


def test_quality_fit_is_ftrl():
    """The model against follow-the-regularised-leader, coordinate by coordinate."""
    import math

    r = random.Random(16)
    texts = [" ".join(r.choice(["a1", "b!", "Cc", "dd"]) for _ in range(r.randint(0, 8))) for _ in range(40)]
    y = [int("a1" in t) for t in texts]
    w, b0 = quality.fit(texts, y)
    z, s, n = {}, {}, 1 << quality.BITS
    rows = []
    for t in texts:
        at = [int(x) for win in spans.windows([t]) for x in quality.features(win)[0]]
        size = sum(len(win) for win in spans.windows([t]))
        rows.append({**{k: quality.SCALE * at.count(k) / size for k in set(at)}, n: 1.0})

    def weight(k):
        if k not in z:
            return 0.0
        l1 = 0.0 if k == n else quality.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((quality.BETA + math.sqrt(s[k])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(rows)):
            x = rows[i]
            now = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(now[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y[i]) * v
                step = (math.sqrt(s.get(k, 0.0) + g * g) - math.sqrt(s.get(k, 0.0))) / quality.ALPHA
                z[k] = z.get(k, 0.0) + g - step * now[k]
                s[k] = s.get(k, 0.0) + g * g
    assert b0 == pytest.approx(weight(n)) and len(z) > 10
    assert all(w[k] == pytest.approx(weight(k), abs=1e-5) for k in z if k != n) and (w != 0).sum() <= len(z)


def test_toxicity(spark, awkward, no_docs, labels):
    r = random.Random(4)
    clean = ["the", "cat", "sat", "mat", "on", "hill", "house"]
    rows = [(i, " ".join(r.choice(clean) for _ in range(60)) + (" you awful moron scum" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = [x for x in toxicity.toxicity(docs, marks, fold(F.col("doc_id"), 4) == 2).collect() if x.held_out]
    assert got and np.mean([x.predicted == int(x.doc_id % 4 == 0) for x in got]) > 0.95
    assert all(x.passages for x in got if x.doc_id % 4 == 0)
    assert toxicity.toxicity(awkward, labels, F.lit(False)).count() == awkward.count()
    assert {x.score for x in toxicity.toxicity(awkward, labels.limit(0), F.lit(False)).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels, F.lit(False)).count() == 0


def test_licenses(spark, awkward, no_docs):
    import re

    texts = [r.text for r in awkward.collect()] + ["Licensed under the Apache License, Version 2.0.", "cc by cc by-nc, CC BY 4.0", "GNU General Public License v3 or GNU Lesser General Public License 2.1", "SPDX-License-Identifier: MIT", "mit der Lizenz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, x) for p, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        # detections by the rules' own expressions, in words, with the same suppression
        hits = [(p, n, len(re.findall(r"\S+", text[: m.start()])), len(re.findall(r"\S+", text[: m.end()])), x) for n, g, needs, x, e, p, _ in licenses.rules() for text in [" ".join(w)] if g in w and (not needs or set(w) & set(licenses.WORD)) for m in re.finditer(rf"(?<![^ ])(?:{e})(?![^ ])", text)]
        kept = {h[1:4] for h in hits if not any(o[2] <= h[2] and h[3] <= o[3] and (o[0] < h[0] or o[0] == h[0] and (o[3] - o[2] > h[3] - h[2] or o[3] - o[2] == h[3] - h[2] and o[1] < h[1])) for o in hits)}
        assert {(d.rule, d.start, d.end) for d in r.detections} == kept
    assert "lgpl-2.1" in got[len(texts) - 3].labels
    assert licenses.scan_licenses(no_docs).count() == 0


def test_licenses_lose_nothing_to_gates(spark):
    """Matches of every rule, with all their optional parts and alternatives at random, against all rules without gates."""
    import re
    from re import _parser

    r = random.Random(9)

    def match(parsed):
        out = ""
        for op, x in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(x)
            elif op == "IN":
                kind, c = r.choice(x)
                out += chr(c) if str(kind) == "LITERAL" else chr(r.randint(*c))
            elif op == "BRANCH":
                out += match(r.choice(x[1]))
            elif op == "SUBPATTERN":
                out += match(x[3])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(match(x[2]) for _ in range(r.randint(x[0], x[1])))
            else:
                raise ValueError(op)
        return out

    every = licenses.rules()
    texts = ["proprietary software", "EULA", "without warranties or conditions of any kind", "end user license agreement", "Responsible AI License", "beer ware license", "Q Public License", "licence agreement", "gpl2"]
    for _, _, needs, _, e, _, _ in every:
        for _ in range(12):
            t = match(_parser.parse(e))
            texts.append(t)
            assert any(g in t.split() for _, g, _, _, x, _, _ in every if x == e) and (not needs or set(t.split()) & set(licenses.WORD)), (e, t)
    texts = texts[:9] + r.sample(texts[9:], 150)
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        t = " ".join(t.lower().split())
        hits = [(p, n, len(t[: m.start()].split()), len(t[: m.end()].split()), x) for n, _, _, x, e, p, _ in every for m in re.finditer(rf"(?<![^ ])(?:{e})(?![^ ])", t)]
        kept = {h[2:] for h in hits if not any(o[2] <= h[2] and h[3] <= o[3] and (o[0] < h[0] or o[0] == h[0] and (o[3] - o[2] > h[3] - h[2] or o[3] - o[2] == h[3] - h[2] and o[1] < h[1])) for o in hits)}
        assert (kept or i > 8) and {(d.start, d.end, d.label) for d in got[i].detections} == kept


def test_common_words_is_a_longest_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        hit = decontaminate.common_words(a, b)
        assert sum(hit) == table[-1][-1]
        rest = iter(b)
        assert all(w in rest for w, x in zip(a, hit, strict=True) if x)


def test_leaks(spark, awkward, no_docs):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(30)) + ". " + " ".join(prose(6)) + ".") for k in range(12)]
    docs = [(i, " ".join(prose(300))) for i in range(60)]
    for k in range(6):
        words = items[k][1].split()
        changed = [w if j % 6 else "zzz" for j, w in enumerate(words)]
        docs[k] = (k, " ".join(prose(90) + words + prose(40)))
        docs[20 + k] = (20 + k, " ".join(prose(10) + changed + prose(70)))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (None, "x")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {(k, k) for k in range(6)} | {(20 + k, k) for k in range(6)}
    assert decontaminate.find_leaks(awkward, bench).count() == 0
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(awkward, bench.limit(0)).count() == 0


def test_leaks_short_items_long_texts_and_cosines(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(30)) + ". " + " ".join(prose(6)) + ".") for k in range(600)] + [(1000, "b2b zebra crossing"), (1001, "Ñandú"), (1002, "echo echo echo " + " ".join(prose(9)))]
    docs = [(1, " ".join(prose(170_000)) + " " + items[5][1]), (2, "A b2b, zebra CROSSING here"), (3, "zebra b2b crossing"), (4, "ñandú!"), (5, items[-1][1]), (6, items[7][1].upper())]
    # one item lies across a window's end
    far = prose(300_000)
    cut = len(" ".join(far).encode()[: spans.WINDOW].decode().split())
    docs.append((7, " ".join(far[: cut - 17] + items[9][1].split() + far[cut - 17 :])))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, 5), (2, 1000), (4, 1001), (5, 1002), (6, 7), (7, 9)}
    start = {x.doc_id: x.start_word for x in got}
    assert abs(start[7] - cut) < 150 and abs(start[1] - 170_000) < 150 and start[2] == 1
    assert all(-1e-3 <= x.cosine <= 1 + 1e-3 for x in got)
    assert all(x.cosine > 0.9 for x in got if x.doc_id in (5, 6))


def test_lengths_of_passages():
    bucket = np.array([3, 3, 3, 5, 3, 5], np.int64)
    weight = np.zeros(1 << decontaminate.BITS, np.float32)
    weight[[3, 5]] = 2, 1
    space = decontaminate.Space(weight, np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    got = space.lengths(bucket, np.array([0, 2]), np.array([4, 6]))
    assert np.allclose(got, [np.sqrt(6**2 + 1), np.sqrt(4**2 + 2**2)])


@pytest.mark.parametrize("share", [0.01, 0.1, 0.3, 0.9])
def test_leaks_of_items_that_are_copied_often(spark, share):
    """Texts of one passage, against the longest common subsequence of every text and item."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijñé") for _ in range(5)) for _ in range(300)] + ["the", "of", "and"] * 60
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(22)) + ". " + " ".join(prose(5)) + " b2b Ñu.") for k in range(6)]
    docs = []
    for i in range(400):
        words = prose(r.randint(30, 45))
        if r.random() < share:
            own = [w.upper() if r.random() < 0.2 else w for w in items[i % 2][1].split() if r.random() < r.choice((1, 0.75, 0.6))]
            words = prose(r.randint(0, 45 - len(own))) + own + prose(3)
        docs.append((i, " — ".join([" ".join(words[:4]), " ".join(words[4:])])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    # inverse frequencies of words, in parts of half a passage, ascii runs of letters and digits apart
    parts = [set(w[i : i + 24]) for _, d in docs for w in [[x for v in decontaminate.words_of(d) for x in re.findall(r"[0-9]+|[^0-9]+", v)]] for i in range(0, len(w), 24)]
    idf = lambda v: max(np.log((1 + len(parts)) / (1 + sum(x in p for p in parts))) for x in re.findall(r"[0-9]+|[^0-9]+", v))
    want = set()
    for k, t in items:
        weight = np.array([idf(w) for w in decontaminate.words_of(t)])
        own, n = decontaminate.words_of(t), len(decontaminate.answer_of(t))
        for i, d in docs:
            hit = decontaminate.common_words(own, decontaminate.words_of(d))
            if (sum(hit) >= 0.7 * len(own) or sum(hit) >= 0.5 * len(own) and sum(hit[-n:]) >= 0.8 * n) and weight[hit].sum() >= 0.5 * weight.sum() - 1e-9:
                want.add((i, k))
    assert want
    found = decontaminate.find_leaks(corpus, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_mixing(spark, awkward, no_docs, labels):
    r = random.Random(8)
    kinds = {"good": ["the", "cat", "sat"], "poor": ["###", "$$$", "%%%"], "toxic": ["moron", "scum", "idiot"]}
    rows = [(i, k, " ".join(r.choice(kinds[k]) for _ in range(40))) for i in range(300) for k in [("good", "good", "poor", "toxic")[i % 4]]]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(k != "poor"), int(k == "toxic")) for i, k, _ in rows if i % 3], "doc_id bigint, quality int, toxic int")
    got = mixing.mix(docs, marks, {"good": 0.7, "poor": 0.2, "toxic": 0.1}).collect()
    total = sum(x.n_words for x in got)
    shares = [sum(x.n_words * x.rate * x.p[k] for x in got) / total for k in range(3)]
    assert np.allclose(shares, [0.7, 0.2, 0.1], rtol=0.01) and all(x.rate >= 0 and abs(sum(x.p) - 1) < 1e-9 for x in got)
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    assert got[0].residual <= mixing.TOLERANCE
    # the fit against the same projected gradient in arrays
    p, n, rate = np.array([x.p for x in got]), np.array([x.n_words for x in got]) / total, np.ones(len(got))
    inverse = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-6, hermitian=True)
    while np.max(np.abs(gap := (rate * n) @ p - np.array([0.7, 0.2, 0.1])) / np.array([0.7, 0.2, 0.1])) > mixing.TOLERANCE:
        rate = np.maximum(0, rate - p @ (inverse @ gap))
    assert np.allclose(rate, [x.rate for x in got], atol=1e-6)
    out = mixing.mixed_documents(awkward, labels)
    assert out.columns == awkward.columns
    assert mixing.mix(awkward, labels).count() == awkward.count()
    assert mixing.mix(no_docs, labels).count() == 0
    assert mixing.mix(awkward, labels.limit(0)).count() == awkward.count()


def test_mixing_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels).collect()
    total = sum(x.n_words for x in got)
    for k, d in enumerate(sorted(mixing.TARGETS)):
        assert abs(sum(x.n_words * x.rate * x.p[k] for x in got) / total / mixing.TARGETS[d] - 1) < 0.01
    assert min(x.rate for x in got) >= 0
    # one that no rates meet
    marks = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    few = mixing.mix(spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id bigint, text string"), marks, {"good": 0.5, "poor": 0.5}).collect()
    assert all(x.rate >= 0 and x.residual >= 0 for x in few)


def test_mixing_returns_repeated_rows(spark, labels):
    rows = [(4, "a b c"), (5, "d e"), (5, "d e"), (5, "d e"), (5, "d"), (8, "a d"), (None, "b"), (None, "b"), (6, None), (6, None)]
    get = lambda r: {(x.doc_id, x.n_words): (tuple(x.p)) for x in r}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, prior = mixing.learn_domains(docs, labels, sorted(mixing.TARGETS))
    got = mixing.posteriors(docs, model, prior).collect()
    order = lambda x: (x[0] is not None, x)
    assert sorted(((x.doc_id, x.n_words) for x in got), key=order) == sorted(((i, len((t or "").split())) for i, t in rows), key=order)
    assert get(got) == get(mixing.posteriors(docs.distinct(), model, prior).collect())
    assert mixing.mix(docs, labels).count() == len(rows)
