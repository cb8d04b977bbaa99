"""Which of many patterns occur in which of many texts (F9, F11, E4): one pass of an automaton over each text.

The distinct patterns become Aho-Corasick automata: a goto table (the patterns' trie), failure links
and outputs. A text is read once per automaton, whatever the number of patterns, and no substrings
are made. Patterns are dealt by hash into automata of bounded size, so a catalog that is too large
for one is matched in as many passes as it has parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spendgrid.session import stored

#: Characters of the patterns of one automaton, about; each is sent to the tasks.
AUTOMATON_CHARS = 1 << 20


def automaton(patterns: list[str]):
    """Goto, failure and output tables of ``patterns``."""
    import ahocorasick  # needed by the tasks only

    tables = ahocorasick.Automaton()
    for p in patterns:
        tables.add_word(p, p)
    tables.make_automaton()
    return tables


def _occurring(shared):
    """Each (key, pattern) of a pattern that occurs in the text, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = automaton(shared.value)
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    here = {p for _, p in tables.iter(text)}
                    at += [i] * len(here)
                    found += here
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["key", "pattern"])

    return run


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``key`` and the columns of ``patterns`` for every pattern that occurs in the text.

    Repeated keys and patterns give a row for each pair; empty patterns and nulls match nothing.
    The distinct patterns are stored and dealt into parts of about ``chars`` characters; what is
    collected and sent at a time is one part. Texts are mapped where they lie, only hits move.
    """
    spark = texts.sparkSession
    distinct = patterns.filter(F.length(pattern) > 0).select(F.col(pattern).alias("pattern")).distinct()
    distinct = stored(distinct, "patterns")
    parts = -(-(distinct.agg(F.sum(F.length("pattern"))).first()[0] or 0) // chars)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("pattern", StringType())])
    hits = spark.createDataFrame([], schema)
    for part in range(parts):
        mine = distinct.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        if words := [r[0] for r in mine.collect()]:  # about ``chars`` characters
            hits = hits.unionByName(rows.mapInArrow(_occurring(spark.sparkContext.broadcast(words)), schema))
    named = patterns.select(F.col(pattern).alias("matched"), F.struct(*[F.col(f"`{c}`") for c in patterns.columns]).alias("row"))
    found = hits.join(named, F.col("pattern") == F.col("matched")).select(F.col("key").alias("key"), "row")
    return found.select(F.col("key").alias(key), "row.*")
