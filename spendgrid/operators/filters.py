"""Filters, searches and cascading options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.functions.measures import any_of


def apply_filters(df: DataFrame, filters=(), on_missing: str = "ignore") -> DataFrame:
    """``[(col, value | tuple)]``; tuple -> IN, scalar -> equality.

    A filter on a column the table lacks is skipped (``on_missing='ignore'``) or raises
    (``'error'``). All predicates land in one Filter that Catalyst pushes to the scan.
    """
    for col, value in filters:
        if col not in df.columns:
            if on_missing == "error":
                raise KeyError(f"filter column {col!r} not in {df.columns}")
            continue
        if isinstance(value, (tuple, list, set, frozenset)):
            df = df.filter(F.col(col).isin(list(value)))
        else:
            df = df.filter(F.col(col) == F.lit(value))
    return df


def search_contains(df: DataFrame, col: str, q: str) -> DataFrame:
    """Literal, case-insensitive ``contains`` on one column; nulls never match."""
    pred = F.coalesce(F.lower(F.col(col)).contains(q.lower()), F.lit(False))
    return df.filter(pred)


def search_any(df: DataFrame, cols: list[str], q: str, id_col: str | None = None) -> DataFrame:
    """OR of literal contains over ``cols`` (or exact id match); distinct entities."""
    preds = [F.coalesce(F.lower(F.col(c).cast("string")).contains(q.lower()), F.lit(False)) for c in cols]
    if id_col is not None:
        preds.append(F.coalesce(F.col(id_col).cast("string") == F.lit(q), F.lit(False)))
    out_cols = cols + ([id_col] if id_col and id_col not in cols else [])
    return df.filter(any_of(preds)).select(*out_cols).distinct()


def options(df: DataFrame, col: str, given=()) -> DataFrame:
    """P10: distinct non-null values of ``col`` restricted by earlier choices."""
    return apply_filters(df, given).select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def only_official(df: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Semi join - keep rows whose ``key`` is in the catalog."""
    return df.join(catalog.select(key), key, "left_semi")
