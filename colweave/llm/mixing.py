"""Soft-membership mixing: document rates whose expected domain totals meet target weights.

DataFrame and SQL functions only.

1. A classifier learned from the labelled table gives each document posteriors over
   domains.  It is a naive Bayes model over hashed words: occurrences by bucket and domain
   are added up over a bounded sample of labelled documents (``TRAIN_ROWS``), each of 2**BITS buckets gets one log-likelihood
   a domain, and a document's posterior is the softmax of its mean over words, sharpened.
2. Nonnegative rates r, one a document, are fitted by projected gradient steps from r = 1 on
   the weighted least squares

       g' W g / 2,     g_d = sum over documents of r n p_d / total - target_d,

   with W the inverse of the second moments of the posteriors by words, so that rare domains
   don't slow the steps down.  Each step is a distributed aggregation over all documents
   (one number a domain comes to the driver) followed by a map.  Steps move along posteriors
   only, which keeps rates near one where targets leave them free.  They end when every
   domain's total is within ``TOLERANCE`` of its target, or when they gain nothing more:
   targets that no rates meet are met as nearly as steps come, and ``residual`` says how nearly.
3. A document of rate r is emitted floor(r + u) times, with u in [0, 1) from a hash of its
   id and text: the expected number of copies is r.

Everything is combined before the shuffle, whatever the size of a source or group of copies.
Defined results: null or wordless texts have 0 words, the labels' prior as
posterior, and the rate of that posterior; several labels of an id count as separate rows; without
labelled rows there is one domain ``other``; unknown target names count as domains with no
documents; repeated rows are separate documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.store import settle

#: Buckets of words; pseudo-count of a bucket in a domain.
BITS, SMOOTH = 16, 0.5
#: Most labelled rows that the classifier is fitted on, by a hash of the id.
TRAIN_ROWS = 20_000
#: Words that a document's evidence counts for at most: its posterior is the softmax of that many times the mean.
SHARPNESS = 40.0
#: Largest share of a target that its total may miss it by; most steps; steps between written tables.
TOLERANCE, STEPS, WRITTEN = 0.001, 200, 8
#: Domains, as values of ``domain_of`` over the labelled table, and the share of words each shall have.
TARGETS = {"good": 0.8, "poor": 0.1, "toxic": 0.1}


def domain_of() -> Column:
    """Domain of a labelled row."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _buckets(text: Column) -> Column:
    """Bucket of every word of a text, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\x0b\f]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - BITS).cast("int"))


def learn_domains(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """Log-likelihoods: bucket, ll (one a domain, less the first one's); and log-priors."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    # labels of ids that no document has are none: they don't use up the bound
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id", "domain"), "doc_id", "domain").limit(TRAIN_ROWS)
    # TRAIN_ROWS rows at most: texts stay where they are, and counts are combined before the shuffle
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", _buckets(F.col("text")).alias("b"))
    one = [F.when(F.col("domain") == d, 1) for d in domains]
    counts = settle(texts.select("domain", F.explode("b").alias("bucket")).groupBy("bucket").agg(*(F.count(x).alias(f"n{k}") for k, x in enumerate(one))), "domain-words")
    totals = counts.agg(*(F.sum(f"n{k}") for k in range(len(domains)))).first()
    sizes = known.agg(*(F.count(x) for x in one)).first()
    room = SMOOTH * (1 << BITS)
    ll = [F.log((F.col(f"n{k}") + SMOOTH) / ((totals[k] or 0) + room)) for k in range(len(domains))]
    prior = [math.log((n + 1) / (sum(sizes) + len(domains))) for n in sizes]
    return counts.select("bucket", *((x - ll[0]).alias(f"l{k}") for k, x in enumerate(ll) if k)), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float]) -> DataFrame:
    """doc_id, row (key of the row by id and text), n_words, p (array over domains that adds up to 1); a repeated row each time."""
    more = list(range(1, len(prior)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), _buckets(F.col("text")).alias("b"))
    # at most 2**BITS rows of a few numbers; unseen buckets tell nothing; bucket -1 counts the row itself
    words = keyed.select("doc_id", "row", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("bucket")).join(F.broadcast(model), "bucket", "left")
    seen = words.groupBy("doc_id", "row").agg(F.count_if(F.col("bucket") < 0).alias("rows"), F.count_if(F.col("bucket") >= 0).alias("n_words"), *(F.sum(F.coalesce(f"l{k}", F.lit(0.0))).alias(f"s{k}") for k in more))
    seen = seen.select("doc_id", "row", "rows", (F.col("n_words") / F.col("rows")).cast("long").alias("n_words"), *((F.col(f"s{k}") / F.col("rows")).alias(f"s{k}") for k in more))
    mean = [F.lit(prior[0])] + [F.lit(prior[k]) + F.col(f"s{k}") * F.least(F.lit(1.0), F.lit(SHARPNESS) / F.greatest("n_words", F.lit(1))) for k in more]
    top = F.greatest(*mean) if more else mean[0]
    e = [F.exp(x - top) for x in mean]
    total = sum(e[1:], e[0])
    each = seen.withColumn("p", F.array(*(x / total for x in e))).withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "row", "n_words", "p")


def fit_rates(docs: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, float]:
    """docs (n_words, p, and more) with their rate; and the largest share of a target that is missed."""
    each = range(len(domains))
    p = [F.get("p", k) for k in each]
    weight = sum(max(0.0, targets.get(d, 0.0)) for d in domains) or 1.0
    goal = np.array([max(0.0, targets.get(d, 0.0)) / weight for d in domains])
    moments = docs.agg(F.sum("n_words").alias("n"), *(F.sum(F.col("n_words") * p[j] * p[k]) for j in each for k in each)).first()
    now = docs.withColumn("rate", F.lit(1.0))
    if not moments.n:
        return now, 0.0
    total = float(moments.n)
    inverse = np.linalg.pinv(np.array(moments[1:]).reshape(len(domains), -1) / total, rcond=1e-6, hermitian=True)
    least, best, still = math.inf, now, 0
    for step in range(STEPS):
        sums = now.agg(*(F.sum(F.col("rate") * F.col("n_words") * x) for x in p)).first()
        gap = np.array(sums) / total - goal
        missed = float(np.max(np.abs(gap) / np.maximum(goal, 1e-3)))
        still = 0 if missed < least * 0.99 else still + 1
        if missed < least:
            least, best = missed, now
        if least <= TOLERANCE or still >= 10:
            break
        if step % WRITTEN == WRITTEN - 1:
            now = settle(now, "rates")
        slope = sum((p[k] * float(x) for k, x in enumerate(inverse @ gap)), F.lit(0.0))
        now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - slope))
    return best, least


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Per document: doc_id, row, n_words, p, rate, copies; the domain of the largest posterior; and the fit's residual."""
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    model, prior = learn_domains(docs, labels, domains)
    rated, residual = fit_rates(settle(posteriors(docs, model, prior), "posteriors"), domains, targets)
    u = F.pmod(F.xxhash64("doc_id", "row", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    named = F.element_at(F.lit(domains), F.array_position("p", F.array_max("p")).cast("int"))
    return rated.select("doc_id", "row", "n_words", "p", "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"), named.alias("domain"), F.lit(residual).alias("residual"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents themselves, each as often as its copies say, with their own columns."""
    chosen = mix(docs, labels, targets).where("copies > 0").select(F.col("row").alias("__row"), "copies").distinct()
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    return keyed.join(chosen, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
