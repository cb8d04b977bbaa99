"""Markdown and code chunkers (T1, T2, T3; W7 and U1 inside).

Each document is one row, so chunking is a per-row array program: split the text into
lines, find the boundary lines, slice the line array per chunk and explode. No shuffle
and no grouping of lines across rows; the work is map-only and scales with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.functions.text import WS, split_lines, strip_ws


def _chunks(lines: Column, starts: Column, heading) -> Column:
    """Array of (start_line, end_line, heading, content) for 1-based chunk ``starts``."""
    n = F.size(lines)

    def one(s, k):
        e = F.when(k + 1 < F.size(starts), F.element_at(starts, k + 2) - 1).otherwise(n)
        content = strip_ws(F.array_join(F.slice(lines, s, e - s + 1), "\n"))
        return F.struct(s.alias("start_line"), e.alias("end_line"), heading(s).alias("heading"), content.alias("content"))

    return F.transform(starts, one)


def _boundary_starts(lines: Column, is_boundary) -> Column:
    """1-based chunk starts: every boundary line, plus line 1 when it is not one."""
    n = F.size(lines)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(idx, lambda i: is_boundary(F.element_at(lines, i)))
    first_is_head = (F.size(heads) > 0) & (F.element_at(heads, 1) == 1)
    return F.when(n == 0, F.array().cast("array<int>")).when(first_is_head, heads).otherwise(
        F.concat(F.array(F.lit(1)), heads)
    )


def _explode(docs: DataFrame, id_col: str, chunks: Column, ctype: str) -> DataFrame:
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("pos", "c"))
    return out.select(
        "doc_id",
        F.col("c.heading").alias("heading"),
        F.col("c.start_line").cast("int").alias("start_line"),
        F.col("c.end_line").cast("int").alias("end_line"),
        F.lit(ctype).alias("type"),
        F.col("c.content").alias("content"),
    ).filter(F.col("content") != "")


def chunk_headings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A line starting with ``#`` opens a chunk (heading = text after the ``#``s);
    text before the first heading is ``General``; blank chunks dropped; 1-based lines."""
    d = docs.select(id_col, text).withColumn("_lines", split_lines(F.col(text)))
    lines = F.col("_lines")

    def heading(s):
        line = F.element_at(lines, s)
        return F.when(line.startswith("#"), strip_ws(F.regexp_replace(line, "^#+", ""))).otherwise(F.lit("General"))

    # boundaries are materialised once per document, then read by every chunk lambda
    d = d.withColumn("_starts", _boundary_starts(lines, lambda l: l.startswith("#")))
    return _explode(d, id_col, _chunks(lines, F.col("_starts"), heading), "markdown")


def _is_h2(line: Column) -> Column:
    return line.startswith("##") & line.rlike(H2_RE)  # cheap prefix test before the regex


def _is_h1(line: Column) -> Column:
    return line.startswith("#") & line.rlike(H1_RE)


H2_RE = rf"^##{WS}+(.+?){WS}*$"
H1_RE = rf"^#{WS}+(.+?){WS}*$"


def chunk_h2(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Split on ``## `` lines only. Text before the first ``## `` is a preamble chunk
    titled by the first ``# `` line (else the document name); a document without any
    ``## `` is one chunk (the whole text, stripped)."""
    d = docs.select(id_col, text).withColumn("_lines", split_lines(F.col(text)))
    lines = F.col("_lines")
    n = F.size(lines)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    h1_lines = F.filter(lines, lambda l: _is_h1(l))
    title = F.when(F.size(h1_lines) > 0, strip_ws(F.regexp_extract(F.element_at(h1_lines, 1), H1_RE, 1))).otherwise(
        F.regexp_replace(F.col(id_col).cast("string"), r"\.[^./]*$", "")
    )
    d = d.withColumn("_h2", F.filter(idx, lambda i: _is_h2(F.element_at(lines, i)))).withColumn("_title", title)
    h2, title = F.col("_h2"), F.col("_title")
    no_h2 = F.array(F.struct(F.lit(1).alias("start_line"), n.alias("end_line"), title.alias("heading"), strip_ws(F.col(text)).alias("content")))
    pre_end = F.element_at(h2, 1) - 1
    preamble = F.struct(
        F.lit(1).alias("start_line"),
        pre_end.alias("end_line"),
        title.alias("heading"),
        strip_ws(F.array_join(F.slice(lines, 1, F.greatest(pre_end, F.lit(0))), "\n")).alias("content"),
    )

    def sect(s, k):
        e = F.when(k + 1 < F.size(h2), F.element_at(h2, k + 2) - 1).otherwise(n)
        head = strip_ws(F.regexp_extract(F.element_at(lines, s), H2_RE, 1))
        content = strip_ws(F.array_join(F.slice(lines, s, e - s + 1), "\n"))
        return F.struct(s.alias("start_line"), e.alias("end_line"), head.alias("heading"), content.alias("content"))

    with_h2 = F.concat(F.array(preamble), F.transform(h2, sect))
    chunks = F.when(F.size(h2) == 0, no_h2).otherwise(with_h2)
    return _explode(d, id_col, chunks, "markdown")


def chunk_code(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A (stripped) line starting ``def `` or ``class `` opens a chunk named by the
    text before ``(`` with those keywords removed; the first chunk is ``modulo``."""
    d = docs.select(id_col, text).withColumn("_lines", split_lines(F.col(text)))
    lines = F.col("_lines")

    def is_def(l):
        s = strip_ws(l)
        return s.startswith("def ") | s.startswith("class ")

    d = d.withColumn("_starts", _boundary_starts(lines, is_def))
    starts = F.col("_starts")

    def heading(s):
        line = F.element_at(lines, s)
        name = F.substring_index(strip_ws(line), "(", 1)
        name = strip_ws(F.replace(F.replace(name, F.lit("def "), F.lit("")), F.lit("class "), F.lit("")))
        return F.when(is_def(line), name).otherwise(F.lit("modulo"))

    return _explode(d, id_col, _chunks(lines, starts, heading), "python")


def inject_headings(docs: DataFrame, marker: str = "# ", every: int = 7, text: str = "text") -> DataFrame:
    """Binding helper (V6): prefix every ``every``-th line with ``marker``; line breaks
    are normalised to ``\\n``."""
    lines = split_lines(F.col(text))
    marked = F.transform(lines, lambda l, i: F.when((i + 1) % every == 0, F.concat(F.lit(marker), l)).otherwise(l))
    return docs.withColumn(text, F.array_join(marked, "\n"))
