"""A training corpus from ``documents``: identify, deduplicate twice, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendgrid.llm import exact_dedup, langid, mixing, packing, simhash
from spendgrid.llm.common import written
from spendgrid.llm.q_dedup import SIMHASH_BITS, SIMHASH_WORDS
from spendgrid.llm.q_mix import MIX_CAP, MIX_SHARE, MIX_WEIGHTS, PACK_BUCKETS, PACK_TOKENS
from spendgrid.session import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without a letter or below the calibrated level go."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id."""
    return simhash.keep_representatives(docs, SIMHASH_WORDS, SIMHASH_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once, or taken twice."""
    return mixing.take_copies(docs, MIX_WEIGHTS, MIX_SHARE, MIX_CAP)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document taken."""
    return packing.pack(docs, PACK_BUCKETS, PACK_TOKENS)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the trained classifier, the fingerprints or the Newton solution.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
