"""Bounded samples of labelled rows, and scores of awkward rows by value."""

import math

import pytest
from pyspark.sql import functions as F

from colweave.llm import langid, mixing, quality, toxicity
from colweave.llm.labelled import labelled_sample
from colweave.llm.store import fold

TEXTS = [None, "", " ", "\n\t ", "same text here", "same text here", "the cat sat on the mat", "you awful moron scum", "...", "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.25, "w") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)], "doc_id bigint, text string, score double, y string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, int(i != 7), int(i == 7)) for i in (4, 6, 7)], "doc_id bigint, quality int, toxic int")


def test_labels_of_absent_ids_use_nothing_up(spark, monkeypatch):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = spark.range(100_000).select((F.col("id") * 7 % 100_000).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    for bound, want in ((60, 60), (500, 100)):
        assert labelled_sample(docs, labels, "quality", F.lit(True), bound).count() == want
    assert labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, 500).count() == docs.where(fold(F.col("doc_id"), 5) != 0).count()
    monkeypatch.setattr(mixing, "TRAIN_ROWS", 100)
    model, prior = mixing.learn_domains(docs, labels, ["good", "poor"])
    seen = model.count()
    assert seen > 90  # a bucket for nearly each of the hundred words
    good = labels.where("doc_id < 100 AND quality = 1").count()
    assert prior == pytest.approx([math.log((good + 1) / 102), math.log((100 - good + 1) / 102)])


def _by_id(rows):
    return {x.doc_id: x for x in rows}


def test_quality_of_awkward_rows(docs, marks):
    got = _by_id(quality.quality(docs, marks, F.lit(False)).collect())
    assert len(got) == len(TEXTS) + 1
    assert len({got[k].score for k in range(4)}) == 1 and got[4].score == got[5].score  # no words: the bias alone
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and not x.held_out for x in got.values())
    assert got[7].score < got[6].score


def test_toxicity_of_awkward_rows(docs, marks):
    got = _by_id(toxicity.toxicity(docs, marks, F.lit(False)).collect())
    assert len(got) == len(TEXTS) + 1
    assert len({got[k].score for k in range(4)}) == 1 and got[4].score == got[5].score
    assert all(not got[k].passages for k in range(4))
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())


def test_languages_of_awkward_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind im haus", "de")] * 20)]
    sample = langid.learn_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", " \n", "123 ...", "the cat sat", "der hund", "der hund", "the dog " * 30_000])], "doc_id bigint, text string")
    got = _by_id(langid.score_languages(asked, sample).collect())
    assert [got[k].lang_pred for k in range(8)] == ["und"] * 4 + ["en", "de", "de", "en"]
    assert got[5].score == got[6].score and all(0 <= x.score <= 1 for x in got.values())
