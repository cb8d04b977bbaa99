"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native DataFrame expressions only. The two cheap keys are counted first; the full hash of a
text decides only inside groups that share both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.common import SPACE_CLASS, numbered, written

PREFIX_CHARS = 64


def normalised(text):
    """The text without its white space (space, U+0009 to U+000D); null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Two texts are equal when their normalised texts are. Of equal texts the row with the most code
    points stays, then the smallest id (null ids come last); of rows that agree in both, one stays.
    Rows whose length or prefix hash is unique are decided without a full hash, and
    ``text_sha256`` is null for them. With ``digest`` every row carries its SHA-256: it is then
    taken in the scan, so that no text moves at all.

    1. count rows by normalised length; 2. among repeated lengths, count by length and hash of the
    first 64 characters; 3. only rows in a repeated group are compared by SHA-256 of the whole
    normalised text. Counts are partial aggregates; without ``digest`` a text moves once, in the
    join that marks repeated keys, whose hot keys adaptive execution splits. An empty table gives
    no rows; extra columns of ``docs`` are ignored.
    """
    return _decided(docs, id_col, text_col, digest).drop("_row").withColumnRenamed("_id", id_col)


def _decided(docs: DataFrame, id_col: str, text_col: str, digest: bool, row: Column | None = None) -> DataFrame:
    """``exact_dedup`` with ``_id`` and ``_row``, the number of each row (given, or made here)."""
    full = F.sha2("_norm", 256)
    numbers = [] if row is None else [row.alias("_row")]
    keyed = docs.select(
        *numbers,
        F.col(id_col).alias("_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("_n"),
        normalised(F.col(text_col)).alias("_norm"),
    ).select(
        *(["_row"] if numbers else []), "_id", "_n", "_norm",
        F.char_length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix"),
    )
    if digest:
        keyed = keyed.withColumn("_norm", full)
    # length and prefix counts come from one scan: a length that occurs once has one prefix that occurs once
    by_prefix = keyed.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_c"))
    by_length = by_prefix.groupBy("_len").agg(F.sum("_c").alias("_l"))
    repeated = (
        by_prefix.join(by_length.filter("_l > 1").select("_len"), "_len", "left_semi")
        .filter("_c > 1")
        .select("_len", "_prefix", F.lit(True).alias("_survives"))
    )
    if not digest:  # once written, its size is known: texts move only if it is too large to be sent to them
        repeated = written(repeated, "exact-repeated")
    marked = keyed.join(repeated, ["_len", "_prefix"], "left").withColumn("_survives", F.coalesce("_survives", F.lit(False)))
    sha = F.col("_norm") if digest else F.when(F.col("_survives"), full)
    # once written, the row number is fixed and tells rows apart that agree in everything
    number = F.col("_row") if numbers else F.monotonically_increasing_id().alias("_row")
    rows = written(marked.select("_id", "_n", "_survives", sha.alias("_sha"), number), "exact-keys")
    # the row that stays: most code points, then the smallest known id, then any one row
    best = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = (
        rows.filter("_survives")
        .groupBy("_sha")
        .agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
        .select("_sha", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_keep_row"), "_size")
    )
    j = rows.join(written(groups, "exact-groups"), "_sha", "left")  # a plain join: a hot group's rows can be split
    grouped = F.col("_size").isNotNull()
    return j.select(
        "_id", "_row",
        F.when(grouped, F.col("_keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (~grouped | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; one row of each group of equal texts.

    Only texts that share length and prefix hash with another are hashed whole. Rows are told apart
    by a number, so null and repeated ids are rows like any other, and
    no column name is reserved.
    """
    stored, number = numbered(docs, "exact-rows")
    dropped = _decided(stored, id_col, text_col, False, F.col(number)).filter("NOT kept").select(F.col("_row").alias(number))
    # written, so that its size is known: documents move only if it is too large to be sent to them
    return stored.join(written(dropped, "exact-dropped"), number, "left_anti").drop(number)
