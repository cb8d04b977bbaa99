"""How far the sources of a language differ from each other and from the language as a whole.

A translate table lower-cases A-Z and blanks every separator byte in one pass, ``bytes.split``
cuts the terms, and a ``Counter`` per document gives its term counts; a term's presence in it is
its document frequency. Tasks add these up per (language, source) before anything is shuffled;
from there on the counts are sparse DataFrames, and absent terms enter only as a baseline share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.llm.common import written

#: Lower-cases A-Z, keeps a-z and every byte of a non-ASCII character, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Cells (group, term) that a task holds before it passes them on.
MAX_CELLS = 1 << 18
#: A block of the pair distances: sources of a tile, and terms on average.
TILE = 128
BLOCK_TERMS = 2048

TALLY = "lang string, source string, term binary, n bigint, docs bigint"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text."""
    return Counter(text.translate(TABLE).split())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), and the documents of each (lang, source) under a null term."""

    def rows():
        at = [(g, t, c) for g, cells in groups.items() for t, c in cells.items()]
        columns = [[g[0] for g, _, _ in at], [g[1] for g, _, _ in at], [t for _, t, _ in at], [c[0] for _, _, c in at], [c[1] for _, _, c in at]]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        groups.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    groups: dict[tuple, dict] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = groups.setdefault((lang, source), {None: [0, 0]})
            cells[None][1] += 1
            for term, n in term_counts(text).items():
                if (cell := cells.get(term)) is None:
                    cells[term] = [n, 1]
                    held += 1
                else:
                    cell[0] += n
                    cell[1] += 1
            if held >= MAX_CELLS:
                yield rows()
                held = 0
    if groups:
        yield rows()


def _share(count: str, total: str, kept: str, smoothing: int, scale: int) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * kept))``, in exact arithmetic."""
    over = f"cast({scale} as decimal(18,0)) * cast({count} + {smoothing} as decimal(20,0))"
    return F.expr(f"1 + ({over}) div cast({total} + {smoothing} * {kept} as decimal(20,0))")


def _block_distances(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute share differences between the sources of two tiles over the terms of one block.

    Rows with a null term carry each source's share of an absent term; what two sources would
    differ by if the block's terms were absent from both is taken off again, so that a term is
    only paid for where it occurs.
    """
    lang, a, b, _ = key
    base = cells[cells["term"].isna()].sort_values("k")
    here = cells[cells["term"].notna()]
    codes, terms = pd.factorize(here["term"])
    sources, absent = base["k"].to_numpy(), base["p"].to_numpy()
    shares = np.repeat(absent[:, None], len(terms), axis=1)
    shares[np.searchsorted(sources, here["k"].to_numpy()), codes] = here["p"].to_numpy()
    first, second, value = [], [], []
    for i in np.flatnonzero(sources // TILE == a):
        others = np.flatnonzero((sources // TILE == b) & (sources > sources[i]))
        first.append(np.full(len(others), sources[i]))
        second.append(sources[others])
        value.append(np.abs(shares[others] - shares[i]).sum(axis=1) - len(terms) * np.abs(absent[others] - absent[i]))
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return pd.DataFrame({"lang": lang, "k1": join(first), "k2": join(second), "part": join(value)})


def audit_sources(
    docs: DataFrame,
    min_docs: int = 30,
    smoothing: int = 5,
    scale: int = 1_000_000_000,
    top_terms: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` over whole texts.

    A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps
    the terms that occur in at least ``min_docs`` of its documents. A group (language, source)
    gives a kept term the share ``1 + floor(scale * (count + smoothing) / (N + smoothing * V))``,
    and so does the language as a whole. Part ``pair``: every other source of the language with
    the sum of absolute share differences over all kept terms. Part ``term``: the ``top_terms``
    terms that occur in the group and have a higher share there than in the language, with the
    difference. ``rank`` counts from 1 along falling values, then items in UTF-8 order.

    Null text, language and source count as empty strings, which are a language and a source like
    any other. A language without kept terms has pairs of value 0 and no terms; an empty table
    gives no rows; repeated rows count as often as they stand; other columns are ignored.

    1. tasks tally their documents, partial sums are added up by (language, source, term);
    2. kept terms and group totals are aggregates of that table; 3. ``term`` rows are ranked with a
    limit in each partition before the shuffle; 4. ``pair`` sums go over blocks of at most two
    tiles of sources and about ``BLOCK_TERMS`` terms, so that neither a source nor a language nor a
    common term is one task's, and are then added up.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    tally = rows.mapInArrow(_tally, TALLY)
    counts = tally.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "audit-counts")
    terms = counts.filter("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = written(kept.filter(F.col("docs") >= min_docs).drop("docs"), "audit-kept")
    cells = written(terms.drop("docs").join(kept, ["lang", "term"]), "audit-cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(langs, "lang", "left")
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    groups = groups.fillna(0, ["v", "lang_n", "group_n"])
    # one row per (language, source) from here: numbered inside the language
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("k", F.row_number().over(by_lang.orderBy("source")).cast("bigint") - 1)
    groups = groups.withColumn("tiles", F.expr(f"(count(1) OVER (PARTITION BY lang) + {TILE - 1}) div {TILE}"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share("0L", "group_n", "v", smoothing, scale)).otherwise(F.lit(0)))
    groups = written(groups, "audit-groups")

    at = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_n", "v", smoothing, scale))
    at = at.withColumn("q", _share("total", "lang_n", "v", smoothing, scale))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    top = at.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    blocks = F.expr(f"(v + {BLOCK_TERMS - 1}) div {BLOCK_TERMS}")
    some = at.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).select("lang", "tiles", "block", "k", "term", "p")
    none = groups.filter("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    none = none.select("lang", "tiles", "block", "k", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"))
    tile, other = F.expr(f"k div {TILE}"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    both = some.unionByName(none).withColumn("other", other).withColumn("tile", tile)
    both = both.select("lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block", "k", "term", "p")
    parts = both.groupBy("lang", "a", "b", "block").applyInPandas(_block_distances, "lang string, k1 bigint, k2 bigint, part bigint")
    parts = written(parts.groupBy("lang", "k1", "k2").agg(F.sum("part").alias("part")), "audit-pairs")
    one = groups.select("lang", "source", "v", "k", "p0")
    two = groups.select("lang", F.col("source").alias("item"), F.col("k").alias("l"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").filter("k <> l").withColumn("k1", F.least("k", "l")).withColumn("k2", F.greatest("k", "l"))
    value = F.coalesce("part", F.lit(0)) + F.col("v") * F.abs(F.col("p0") - F.col("q0"))
    pairs = pairs.join(parts, ["lang", "k1", "k2"], "left").select("lang", "source", "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    out = [df.withColumn("part", F.lit(part)) for part, df in (("pair", pairs), ("term", top))]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", "value", "rank")
