"""Registered query: token counts (op9)."""

from __future__ import annotations

import public_tokenizers

from spendgrid.llm.token_count import count_tokens
from spendgrid.session import read_table

#: Fixed by the task: the vocabulary file and the length that is over the limit.
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op9_token_count(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), TOKEN_LIMIT)


QUERIES = {"op9_token_count": op9_token_count}
SQL = {}
