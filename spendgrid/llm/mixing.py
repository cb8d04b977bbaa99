"""Mixing sources to target weights by entropy balancing.

Native DataFrame expressions. Each source has one token constraint: the rates ``r`` of its
documents must satisfy ``sum(r * size) = target``. The rates closest to one in relative entropy
under ``0 <= r <= cap`` are exponentially tilted, ``r = min(cap, exp(lambda * size / mean size))``;
``lambda`` is the root of the derivative of a convex dual, one per source, found by Newton steps
that each sum over the distributed (source, size) histogram. Rates then become whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.llm.common import WORD, numbered, unused_name, written

#: A (source, size) cell is dealt out in parts of about this many rows, so that none is sorted whole.
CELL_PART_ROWS = 1_000


def word_count(text: Column) -> Column:
    """Words of a text, maximal runs without white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: list[tuple[str | None, int]], weights: list[float], share: float, cap: float) -> list[dict]:
    """Target of each ``(source, size)``, the sources in code-point order with null last.

    The weights repeat along the sources and share ``share`` times all sizes. A target stops at
    ``cap`` times its source's size; the excess is shared again by weight among the others, until
    none is above. Where every source stops, the rest of the budget is not given out.
    """
    order = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))  # one row per source: a mixing configuration
    rows = [{"source": s, "source_size": n, "weight": weights[i % len(weights)], "target": None} for i, (s, n) in enumerate(order)]
    budget = share * sum(n for _, n in order)
    while open_rows := [r for r in rows if r["target"] is None]:
        total = sum(r["weight"] for r in open_rows)
        full = [r for r in open_rows if budget * r["weight"] / total > cap * r["source_size"]]
        if not full:
            for r in open_rows:
                r["target"] = budget * r["weight"] / total
            break
        for r in full:
            r["target"] = float(cap * r["source_size"])
        budget -= sum(r["target"] for r in full)
    return rows


def _solve(hist: DataFrame, sources: DataFrame, cap: float, steps: int, tol: float) -> DataFrame:
    """``lam`` per source: safeguarded Newton steps, all sources at once, over the histogram.

    Each step is one partial aggregate over the histogram. A Newton step that leaves the bracket
    of its root is replaced by a bisection. Sources whose target is the cap, or that hold no
    words, are settled without a step.
    """
    spark = hist.sparkSession
    state = {
        r["key"]: {"lam": 0.0, "lo": None, "hi": None, "target": r["target"], "done": r["target"] >= cap * r["source_size"] or r["target"] <= 0}
        for r in sources.select("key", "target", "source_size").collect()  # one row per source
    }
    for _ in range(steps):
        todo = [(k, s["lam"]) for k, s in state.items() if not s["done"]]
        if not todo:
            break
        lam = spark.createDataFrame(todo, "key int, lam double")
        tilt = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        sums = (
            hist.join(lam, "key")
            .withColumn("tilt", tilt)
            .groupBy("key")
            .agg(
                F.sum(words * F.least("tilt", F.lit(float(cap)))).alias("value"),
                F.sum(F.when(F.col("tilt") < cap, words * F.col("z") * F.col("tilt")).otherwise(0.0)).alias("slope"),
            )
        )
        for r in sums.collect():  # one row per source
            s = state[r["key"]]
            gap = r["value"] - s["target"]
            if abs(gap) <= tol * s["target"]:
                s["done"] = True
                continue
            s["lo" if gap < 0 else "hi"] = s["lam"]
            step = s["lam"] - gap / r["slope"] if r["slope"] > 0 else None
            lo, hi = s["lo"], s["hi"]
            if step is None or (lo is not None and step <= lo) or (hi is not None and step >= hi):
                if lo is not None and hi is not None:
                    step = (lo + hi) / 2
                else:
                    step = s["lam"] + (1.0 if gap < 0 else -1.0) * max(1.0, abs(s["lam"]))
            s["lam"] = float(f"{step:.12g}")  # the order in which Spark adds doubles does not show
    return spark.createDataFrame([(k, s["lam"]) for k, s in state.items()], "key int, lam double")


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    cap: int = 2,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    newton_steps: int = 60,
    tol: float = 1e-6,
) -> DataFrame:
    """Copies per document: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    ``size`` defaults to the number of words (null text: 0); a null source is a source of its own.
    ``copies`` is 0 to ``cap``, ``taken = copies * size``; documents without words get one copy
    of nothing. Equal sizes in a source share a rate, so the histogram cell is the unit: cumulated
    expected copies along the sizes are rounded, then what is still missing is mended on ever
    smaller documents (three passes), which brings each source within about its smallest
    documents of the target. Inside a cell the documents with the smallest hash of their id get
    the extra copies, so reruns agree; rows that agree in all columns are interchangeable.

    What is collected is one row per source. Windows run over histogram cells (at most the
    distinct sizes of a source) and over hashed parts of one cell, never over the rows of a source.
    """
    mixed = _mixed(docs, weights, share, cap, size, id_col, source_col, text_col, newton_steps, tol)
    return mixed.drop("row").withColumnsRenamed({"id": id_col, "source": source_col})


def _mixed(docs, weights, share, cap, size, id_col, source_col, text_col, newton_steps=60, tol=1e-6, row=None) -> DataFrame:
    """``id, source, size, source_size, target, rate, copies, taken`` and ``row``, the number of each row (given, or made here)."""
    spark = docs.sparkSession
    size = word_count(F.col(text_col)) if size is None else size
    row = F.monotonically_increasing_id() if row is None else row
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row"))
    base = written(base, "mix-sizes")
    hist = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.max("size").alias("max_size")
    )
    got = {r["source"]: r for r in sizes.collect()}  # one row per source
    targets = source_targets([(s, r["source_size"]) for s, r in got.items()], weights, share, cap)
    sources = spark.createDataFrame(
        [(i, t["source"], t["source_size"], float(t["target"]), t["source_size"] / max(got[t["source"]]["docs"], 1)) for i, t in enumerate(targets)],
        "key int, source string, source_size bigint, target double, mean_size double",
    )
    by_source = F.col("h.source").eqNullSafe(F.col("s.source"))
    hist = hist.alias("h").join(sources.alias("s"), by_source).select("key", "size", "n", "target", "source_size", "mean_size")
    hist = hist.withColumn("z", F.when(F.col("mean_size") > 0, F.col("size") / F.col("mean_size")).otherwise(0.0))
    hist = written(hist, "mix-histogram")
    lam = _solve(hist, sources, cap, newton_steps, tol)
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("z"), F.lit(700.0))))
    rate = F.when(F.col("target") >= cap * F.col("source_size"), float(cap)).when(F.col("target") <= 0, 0.0).otherwise(rate)
    cells = hist.join(lam, "key").withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
    # whole copies of a cell: differences of the rounded running sum of expected copies
    up = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("expected", F.floor(F.sum(F.col("n") * F.col("rate")).over(up) + 0.5))
    before = F.coalesce(F.lag("expected").over(Window.partitionBy("key").orderBy("size")), F.lit(0))
    total = F.least(F.greatest(F.col("expected") - before, F.lit(0)), F.col("n") * cap)
    cells = cells.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(total).cast("bigint"))
    whole = Window.partitionBy("key")
    down = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(3):
        # words still missing (or too many), mended from the largest sizes that fit down to the smallest
        cells = cells.withColumn("gap", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        free = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        cells = cells.withColumn("room", F.when(fits, free).otherwise(0))
        cells = cells.withColumn("used", F.coalesce(F.sum(F.col("room") * F.col("size")).over(down), F.lit(0)))
        left = F.abs("gap") - F.col("used")
        add = F.when(fits & (left > 0), F.least("room", F.floor(left / F.col("size")))).otherwise(0)
        cells = cells.withColumn("copies", (F.col("copies") + F.signum("gap").cast("int") * add).cast("bigint"))
    parts = F.ceil(F.col("n") / F.lit(CELL_PART_ROWS)).cast("int")
    cells = cells.select("key", "size", "rate", "copies", "n", parts.alias("parts"))
    cells = written(cells, "mix-cells")
    rows = base.alias("h").join(sources.alias("s"), by_source).select("id", "row", "h.source", "size", "key", "source_size", "target")
    rows = rows.join(cells.withColumnRenamed("n", "cell_rows"), ["key", "size"])
    # rows without an id are told apart by their number alone
    rows = rows.withColumn("hash", F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id")))
    rows = rows.withColumn("part", F.pmod("hash", "parts"))
    # extra copies of a cell go to its first ``copies mod n`` rows along (part, hash, id, row)
    in_parts = rows.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_parts = in_parts.withColumn("offset", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0))).drop("part_rows")
    rows = rows.join(in_parts, ["key", "size", "part"])
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("hash", "id", "row"))
    rows = rows.withColumn("rank", rank)
    extra = (F.col("rank") <= F.col("copies") % F.col("cell_rows")).cast("bigint")
    rows = rows.withColumn("copies", F.expr("copies div cell_rows") + extra)
    return rows.select("id", "row", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    cap: int = 2,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The rows of the mix: each row of ``docs``, all columns, as often as ``mix_sources`` takes it.

    Rows are told apart by a number, so null and repeated ids are rows
    like any other, and no column name is reserved.
    """
    stored, number = numbered(docs, "mix-rows")
    copies = unused_name(stored, "_copies")
    taken = _mixed(stored, weights, share, cap, size, id_col, source_col, text_col, row=F.col(number)).filter("copies > 0")
    taken = written(taken.select(F.col("row").alias(number), F.col("copies").cast("int").alias(copies)), "mix-taken")
    j = stored.join(taken.hint("merge"), number)  # both sides grow with the documents: one plan at every size
    return j.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(number, copies)
