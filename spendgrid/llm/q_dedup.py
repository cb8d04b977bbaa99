"""Registered queries: the deduplication operators (op1, op6, op8, op10) and their twins."""

from __future__ import annotations

from spendgrid.llm.embedding_dedup import embedding_groups
from spendgrid.llm.exact_dedup import exact_dedup
from spendgrid.llm.simhash import simhash_groups
from spendgrid.llm.suffix_dedup import remove_repeats
from spendgrid.session import read_table

#: Fixed by the task for SimHash: words in a shingle, and differing bits of a link.
SIMHASH_WORDS = 3
SIMHASH_BITS = 2
#: Fixed by the task for embeddings: the least cosine of a link.
EMBEDDING_COSINE = 0.98
#: Fixed by the task for repeated passages: bytes of a repeated string.
REPEAT_BYTES = 200


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents"), REPEAT_BYTES)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest=True)


_OP6_SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)"""


def op10_simhash(spark, sf_dir):
    return simhash_groups(read_table(spark, sf_dir, "documents"), SIMHASH_WORDS, SIMHASH_BITS)


def op8_embedding_dedup(spark, sf_dir):
    return embedding_groups(read_table(spark, sf_dir, "embeddings"), EMBEDDING_COSINE)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op6_exact_dedup": op6_exact_dedup, "op8_embedding_dedup": op8_embedding_dedup, "op10_simhash": op10_simhash}
SQL = {"op6_exact_dedup": _OP6_SQL}
