"""Registered query: embedding whitening (op13)."""

from __future__ import annotations

from spendgrid.llm.whitening import whiten
from spendgrid.session import read_table

#: Fixed by the task: principal components of a row.
COMPONENTS = 8


def op13_whitening(spark, sf_dir):
    return whiten(read_table(spark, sf_dir, "embeddings"), COMPONENTS)


QUERIES = {"op13_whitening": op13_whitening}
SQL = {}
