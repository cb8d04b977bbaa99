"""Language ID: held-out accuracy, rejection and what is learned from."""

import zlib

import pytest
from pyspark.sql import functions as F

from spendgrid.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents)


def test_held_out_accuracy(documents, model):
    got = langid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").filter(langid.held_out("doc_id")).collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    right = [r for r in got if r.lang_pred == r.lang]
    assert sum(r.rejected for r in right) <= 0.01 * len(right)


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, "text " * 3, "en") for i in range(50)] + [(None, "sans id", "fr"), (60, None, "de"), (61, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.training_rows(docs).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    flags = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(50)) and flags[None] is False


def test_texts_without_letters_are_rejected(make_docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 ... \n"), (4, "a"), (5, "the " * 200_000), (6, "the of and"), (6, "the of and"), (None, "der die das und")]
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(make_docs(rows), model).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= got
    assert {p for d, p, _ in got if d in (5, 6)} == {"en"} and (None, "de", False) in got
    docs = make_docs(rows)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == langid.identify(docs, model).filter(~F.col("rejected")).count() <= 5


def test_same_rows_same_model_whatever_the_order():
    rows = [(f"the and of {i} is", "en") for i in range(30)] + [(f"der die und {i} ist", "de") for i in range(30)]
    a, b = langid.fit(rows, epochs=2), langid.fit(rows[::-1], epochs=2)
    assert (a.table == b.table).all() and a.temperature == b.temperature
    assert a.predict("the and of")[0] == "en" and a.predict("der die und")[0] == "de"


def test_empty_table(make_docs):
    docs = make_docs([])
    model = langid.train(docs)
    assert langid.identify(docs, model).collect() == [] and model.predict("abc")[0] == "und"


def test_long_text_block_by_block(monkeypatch):
    text = "Ein längerer Text, der über Blöcke geht. " * 50
    whole = langid.subword_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert (langid.subword_counts(text) == whole).all()
