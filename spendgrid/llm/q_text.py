"""Registered queries over texts and pages: HTML extraction (op2) and language ID (op4)."""

from __future__ import annotations

from spendgrid.llm import langid
from spendgrid.llm.html_extract import extract
from spendgrid.session import read_table


def op4_langid(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op2_html_extract(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extract": op2_html_extract, "op4_langid": op4_langid}
SQL = {}
