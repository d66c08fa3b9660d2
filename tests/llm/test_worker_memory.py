"""Workers go from step to step: what one step keeps there doesn't stay while the next one keeps something else."""

import gc
import weakref

import public_tokenizers

import corpus_pipeline as P
from colweave.llm import langid, similar, spans, token_shards
from colweave.llm.store import collect_garbage


def test_a_step_gives_up_what_the_one_before_kept():
    sample = {"en": ["the house on the hill"], "de": ["das haus auf dem berg"]}
    path = public_tokenizers.path("word_bpe_49k.json")
    parser = weakref.ref(langid._parser("a model", sample))
    assert parser() is langid._parser("a model", sample)
    known = similar.digests([b"house", b"hill"])
    gc.collect()
    assert parser() is None
    assert similar.digests([b"berg"]) is known and len(known) == 3
    encoder = weakref.ref(token_shards._encoder(path))
    assert encoder() is token_shards._encoder(path) and encoder().encode("a house") == encoder().encode("a house")
    assert len(next(spans.windows(["a house"]))) == 2
    gc.collect()
    assert encoder() is None


def test_batches_of_texts_are_small_and_texts_are_sent_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows, then in ((10_000, P.BATCH_ROWS), (0, P.BATCH_ROWS), (70, 70)):
            spark.conf.set(name, rows)
            P._small_batches(spark)
            assert int(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, before)
    docs = spark.createDataFrame([(1, "the hill", "en"), (2, None, "de")], "doc_id bigint, text string, lang string")
    scored = langid.score_languages(docs, {"en": ["the house on the hill"]}, keep=("lang", "text"))
    assert sorted((r.doc_id, r.lang_pred, r.text, r.lang) for r in scored.collect()) == [(1, "en", "the hill", "en"), (2, "und", None, "de")]


def test_powers_are_as_many_as_needed():
    few = [x.copy() for x in spans._powers(10)]
    many = spans._powers(spans.WINDOW + 1)
    assert len(few[0]) <= len(many[0]) == spans.WINDOW + 1
    assert all((x == y[: len(x)]).all() for x, y in zip(few, many, strict=True))
    token_shards._encoder(public_tokenizers.path("word_bpe_49k.json"))
    next(spans.windows(["a house"]))
    assert len(spans._powers(1)[0]) < 100


def test_handles_that_refer_to_themselves_go(spark):
    gc.collect()
    handle = spark.range(3)._jdf
    handle.count()  # a method that was called is kept by the handle, and keeps the handle
    gone = weakref.ref(handle)
    gc.disable()
    try:
        del handle
        collect_garbage(spark)
        assert gone() is None
    finally:
        gc.enable()
