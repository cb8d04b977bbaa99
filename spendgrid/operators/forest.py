"""Random forests of few features, grown from sums per cell (M8).

A forest sees a feature only as the bin that it falls into, so rows with the same bins are one cell, and
everything that a tree asks of its bag are sums over cells: of the bag's weights, of the target and of
its square. One pass draws each row's weight in every tree's bag and adds up these sums per fold and
cell; a fold's training sums are the total without it. The trees then grow from the sums, whatever the
number of rows. There are at most ``BINS ** features`` cells, so this is for few features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As Spark ML's forests: bins of a feature, levels of splits of a tree.
BINS, DEPTH = 32, 5
#: Cells that sums are kept for: numbers of a fold are three a target, tree and cell.
CELLS = 4096


def fits(features: int) -> bool:
    return BINS**features <= CELLS


def thresholds(df: DataFrame, xs: list[str]) -> list[np.ndarray]:
    """Split points of each feature: between all its values, or quantiles of a feature with more than ``BINS``."""
    at = [i / BINS for i in range(1, BINS)]
    each = [a for x in xs for a in (F.approx_count_distinct(x).alias(f"n_{x}"), F.percentile_approx(x, at, 10_000).alias(f"q_{x}"))]
    row, out = df.agg(*each).first(), []
    for x in xs:
        cut = np.unique(np.array(row[f"q_{x}"] or [], dtype=float))
        if row[f"n_{x}"] <= 2 * BINS:
            values = np.sort(np.array([r[0] for r in df.select(x).distinct().collect()], dtype=float))  # about 2 * BINS
            if len(values) <= BINS:
                cut = (values[1:] + values[:-1]) / 2
        out.append(cut)
    return out


def _cells(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    cell = np.zeros(len(columns[0]), dtype=np.int64)
    for x, cut in zip(columns, cuts, strict=True):
        cell = cell * (len(cut) + 1) + np.searchsorted(cut, x, side="left")
    return cell


def _numbers(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fold and the other columns of a batch; as in Spark ML's forests, a missing number is an error."""
    fold, *rest = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns))
    rest = [x.astype(float) for x in rest]
    if any(np.isnan(x).any() for x in rest):
        raise ValueError("a target or feature of a forest is null or NaN")
    return fold, rest


def _sums(cuts: list[np.ndarray], cells: int, trees: int, seed: int):
    """Per fold: sums of weight, and of weight times each target and its square, by cell and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: dict[int, np.ndarray] = {}
        for b in batches:
            fold, (y, t, *xs) = _numbers(b)
            cell = _cells(xs, cuts)
            order = np.lexsort((cell, fold))
            fold, cell, y, t = fold[order], cell[order], y[order], t[order]
            bag = rng.poisson(1.0, (len(cell), trees)).astype(float)
            starts = np.flatnonzero(np.append(True, (np.diff(fold) != 0) | (np.diff(cell) != 0)) if len(cell) else np.zeros(0, bool))
            for i, v in enumerate((None, y, y * y, t, t * t)):
                part = np.add.reduceat(bag if v is None else bag * v[:, None], starts, axis=0) if len(starts) else bag
                for f in np.unique(fold).tolist():
                    mine = fold[starts] == f
                    held.setdefault(f, np.zeros((5, cells, trees)))[i, cell[starts][mine]] += part[mine]
        for f, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], ["fold", "s"])

    return run


def _added(t: pa.Table) -> pa.Table:
    rows = t["s"].combine_chunks()
    s = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
    return pa.table({"fold": t["fold"].slice(0, 1), "s": pa.array([s], pa.list_(pa.float64()))})


def _tree(w: np.ndarray, s: np.ndarray, q: np.ndarray, bins: list[np.ndarray], seed: list[int]) -> np.ndarray:
    """The prediction of every cell: the mean of its leaf. A node splits on the best of a random third of
    the features, where the sum of squared deviations falls most; no leaf is empty. The features of a node
    follow from ``seed`` and its place alone, so both targets' trees ask for the same, as one seed does in Spark ML."""
    out = np.zeros(len(w))

    def grow(mine: np.ndarray, depth: int, node: int = 1) -> None:
        total = w[mine].sum()
        out[mine] = s[mine].sum() / total if total > 0 else 0.0
        if depth == DEPTH:
            return
        best = (0.0, None, None)
        for f in np.random.default_rng([*seed, node]).permutation(len(bins))[: -(-len(bins) // 3)]:
            n, a, b = (np.cumsum(np.bincount(bins[f][mine], weights=x[mine], minlength=2)) for x in (w, s, q))
            left, right = n[:-1], n[-1] - n[:-1]
            ok = (left >= 1) & (right >= 1)
            if ok.any():
                gain = a[:-1][ok] ** 2 / left[ok] + (a[-1] - a[:-1][ok]) ** 2 / right[ok] - a[-1] ** 2 / n[-1]
                at = int(gain.argmax())
                if gain[at] > 1e-12 * b[-1] and gain[at] > best[0]:  # beyond rounding
                    best = (gain[at], f, int(np.flatnonzero(ok)[at]))
        if best[1] is not None:
            low = mine[bins[best[1]][mine] <= best[2]]
            grow(low, depth + 1, 2 * node)
            grow(mine[bins[best[1]][mine] > best[2]], depth + 1, 2 * node + 1)

    grow(np.arange(len(w)), 0)
    return out


def residuals(df: DataFrame, xs: list[str], folds: int, trees: int = 50, seed: int = 42) -> DataFrame:
    """``ry, rt``: targets ``y`` and ``t`` of ``df(fold, y, t, *xs)`` without what forests of the other folds
    predict, for the folds 0 up to ``folds``. The rows are read four times."""
    spark = df.sparkSession
    rows = df.filter(F.col("fold").isNotNull()).select(F.col("fold").cast("int").alias("fold"), "y", "t", *xs)
    cuts = thresholds(rows, xs)
    sizes = [len(c) + 1 for c in cuts]
    cells = int(np.prod(sizes))
    dealt = rows.coalesce(2 * spark.sparkContext.defaultParallelism)  # a task keeps sums, not rows
    sums = dealt.mapInArrow(_sums(cuts, cells, trees, seed), "fold int, s array<double>").groupBy("fold").applyInArrow(_added, "fold int, s array<double>")
    held = {r["fold"]: np.array(r["s"]).reshape(5, cells, trees) for r in sums.collect()}  # 5 * trees * CELLS numbers a fold at most
    bins = [x.ravel() for x in np.meshgrid(*[np.arange(n) for n in sizes], indexing="ij")]
    guess = np.zeros((folds, 2, cells))
    for k in range(folds):
        train = sum((s for f, s in held.items() if f != k), np.zeros((5, cells, trees)))
        for target, (s, q) in enumerate(((1, 2), (3, 4))):
            for i in range(trees):
                guess[k, target] += _tree(train[0, :, i], train[s, :, i], train[q, :, i], bins, [seed, i]) / trees

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, (y, t, *columns) = _numbers(b)
            cell = _cells(columns, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(y - guess[fold, 0, cell]), pa.array(t - guess[fold, 1, cell])], ["ry", "rt"])

    return rows.filter((F.col("fold") >= 0) & (F.col("fold") < folds)).mapInArrow(left, "ry double, rt double")
