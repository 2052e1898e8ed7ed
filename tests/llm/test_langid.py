import random
import zlib

import pytest

from tickloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(told) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in told.items())
    held = [d for d in told if told[d].held_out]
    assert sum(told[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in told.values()) and sum(r.rejected for r in told.values()) <= 0.01 * len(told)


def test_odd_rows_and_no_labels(make_docs, odd_docs, odd_rows, no_docs):
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows = labelled + [(100, None, "en"), (101, "123 !?", None), (102, "und der hund", None), (None, "and the dog", "en")]
    got = {r.doc_id: r for r in langid.identify(make_docs(rows)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and got[101].rejected
    assert got[102].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(r.lang_pred == "und" and r.rejected for r in langid.identify(odd_docs).collect())  # nothing to learn from
    assert langid.identify(odd_docs).count() == len(odd_rows) and langid.identify(no_docs).collect() == []


def test_subwords_do_not_cross_words():
    bucket, n = langid.subwords(["ab", "", "a b", "AB"])
    assert n.tolist() == [2 + 3 + 2 + 1, 0, 2 + 4 + 2, 8] and sorted(bucket[:8]) == sorted(bucket[16:])


FOREIGN = ["kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto",
           "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem",
           "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"]


@pytest.mark.parametrize("labels", [["en"], ["en", "de"], ["en", "de", "fr", "es"]])
def test_foreign_and_random_texts_are_rejected(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.filter(docs.lang.isin(labels))
    _, learn, calibrate = langid.held_out()
    model = langid.train(docs, learn, calibrate)
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)) for _ in range(n)) for k in (5, 7, 12) for n in (20, 100)]
    assert all(model.predict(FOREIGN + noise)[2])
    texts = [r.text for r in docs.collect() if r.text]
    assert sum(model.predict(texts)[2]) <= 0.01 * len(texts)
