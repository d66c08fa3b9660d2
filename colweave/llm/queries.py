"""Queries opN_<name> over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from colweave.llm.clusters import cluster
from colweave.llm.decontaminate import find_leaks
from colweave.llm.langid import learn_languages, score_languages
from colweave.llm.licenses import scan_licenses
from colweave.llm.mixing import mix
from colweave.llm.quality import quality
from colweave.llm.relative import strip_repeats
from colweave.llm.simhash import near_duplicates
from colweave.llm.store import fold, read_table, ship
from colweave.llm.token_counts import count_tokens
from colweave.llm.token_shards import token_shards
from colweave.llm.topk import top_k
from colweave.llm.toxicity import toxicity
from colweave.llm.variants import variants

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=3, max_bits=2, segments=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


ORACLES["op5_top_k"] = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [floor(256.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    return score_languages(docs, learn_languages(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2).drop("passages")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_words", "domain", *(F.get("p", k).alias(f"p_{d}") for k, d in enumerate(("good", "poor", "toxic"))), "rate", "copies", "residual")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"), count=8, rounds=10, scale=1024.0, dims=64, seed=3)


def _rounds(n: int) -> str:
    """Common table expressions c0 to c<n> (c, v) of centroids over kept vectors k (r, vec_id, v), and the last assignment ``placed``."""
    near = "SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) AS b FROM k, {0} c GROUP BY k.r"
    out = ["c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM k WHERE vec_id IS NOT NULL QUALIFY c < 8)"]
    for i in range(1, n + 1):
        out.append(f"a{i} AS MATERIALIZED ({near.format(f'c{i - 1}')})")
        sums = f"SELECT b.c AS c, j, CAST(sum(CAST(v[j] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY ALL"
        out.append(f"c{i} AS MATERIALIZED (SELECT o.c AS c, coalesce(w.v, o.v) AS v FROM c{i - 1} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS v FROM ({sums}) GROUP BY c) w ON w.c = o.c)")
    out.append(f"placed AS MATERIALIZED ({near.format(f'c{n}')})")
    return ", ".join(out)


ORACLES["op11_centroids"] = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, [floor(1024.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64),
{_rounds(10)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN f.v], ',')) AS centroid_sha256
FROM placed p JOIN c10 f ON f.c = p.b.c
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(read_table(spark, sf_dir, "documents"), window=50).drop("text", "factors")


ORACLES["op12_substring_dedup"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (
  SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) AND doc_id IS NOT NULL THEN md5(array_to_string(w[i:i + 49], ' ')) END AS k
  FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
f AS (SELECT k, min(doc_id) AS first FROM p WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT p.*, coalesce(f.first < p.doc_id, false) AS again FROM p LEFT JOIN f ON f.k = p.k),
c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
g AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"), every=199, least_letters=6, least=5, ratio=5)


ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run), '..')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spots AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS MATERIALIZED (
  SELECT DISTINCT x.word, y.word AS other, y.n AS other_n FROM spots x JOIN spots y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM spots x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM spots x JOIN words y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, min({'n': -other_n, 'w': other}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * n THEN b.w END AS form, CASE WHEN -b.n >= 5 * n THEN -b.n END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
ways(word, root, form) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN formed f ON f.word = w.form)
SELECT f.word, f.form, w.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN ways w ON w.word = f.word AND w.form IS NULL
"""
