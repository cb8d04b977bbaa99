"""Packing: optimal length buckets, and token-budget batches inside each bucket."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.llm.common import written
from spendgrid.llm.mixing import word_count

#: Batches are formed inside hashed parts of a bucket of about this many rows.
PART_ROWS = 50_000


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    ``histogram`` holds ``(length, rows)`` with distinct lengths. Dynamic programming over the
    sorted lengths: with prefix counts N and prefix lengths S, the padding of a bucket (i, j] is
    ``len_j * (N_j - N_i) - (S_j - S_i)``. For a fixed number of buckets the best i is the lower
    envelope of lines with slope ``-N_i`` at ``len_j``; slopes fall and queries rise, so each layer
    takes one pass. Exact integers throughout; ties take the earliest split.
    """
    hist = sorted(histogram)
    if not hist:
        return []
    length = [h[0] for h in hist]
    count, total = [0], [0]
    for x, n in hist:
        count.append(count[-1] + n)
        total.append(total[-1] + x * n)
    m = len(hist)
    best = [length[j - 1] * count[j] - total[j] if j else 0 for j in range(m + 1)]  # one bucket
    splits = [[0] * (m + 1)]
    for _ in range(min(buckets, m) - 1):
        hull: deque[int] = deque()
        value, split = [0] * (m + 1), [0] * (m + 1)
        icept = [best[i] + total[i] for i in range(m + 1)]

        def crowded(a, b, c):  # line b is nowhere below both a and c
            return (icept[c] - icept[a]) * (count[b] - count[a]) <= (icept[b] - icept[a]) * (count[c] - count[a])

        for j in range(1, m + 1):
            i = j - 1
            while len(hull) > 1 and crowded(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            at = lambda k: icept[k] - count[k] * length[j - 1]  # noqa: B023,E731
            while len(hull) > 1 and at(hull[1]) < at(hull[0]):
                hull.popleft()
            split[j] = hull[0]
            value[j] = length[j - 1] * count[j] - total[j] + at(hull[0])
        best = value
        splits.append(split)
    bounds, j = [], m
    for split in reversed(splits):
        if j == 0:
            break
        bounds.append(length[j - 1])
        j = split[j]
    return bounds[::-1]


def pack(
    docs: DataFrame,
    buckets: int = 16,
    token_budget: int = 65_536,
    multiple_of: int = 8,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bucket and batch of every row: ``doc_id, n_tokens, bucket, bucket_len, batch, slot, n_padding``.

    ``length`` (default: words of the text) counts a row's tokens; null and empty texts have none
    and form padding-free rows of the smallest bucket. A row's padded length is its bucket's upper
    bound, a multiple of ``multiple_of``; whole rows are kept, however long. A batch holds as many
    rows as ``token_budget`` takes at the bucket's length, at least one. Batches are formed in
    hashed parts of a bucket, so a bucket with most of the rows is not dealt out by one task; each
    part has one batch that may be short. ``batch`` is unique over all buckets.

    What is collected is the histogram of padded lengths: at most the longest text divided by
    ``multiple_of`` entries, however many rows there are. Repeated rows are packed each.
    """
    spark = docs.sparkSession
    length = word_count(F.col(text_col)) if length is None else length
    padded = (F.ceil(F.col("n_tokens") / F.lit(multiple_of)) * multiple_of).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), length.cast("bigint").alias("n_tokens")).withColumn("padded", padded)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pack-lengths")
    hist = [(r["padded"], r["n"]) for r in rows.groupBy("padded").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = optimal_boundaries(hist, buckets)
    in_bucket = [0] * len(bounds)
    for x, n in hist:
        in_bucket[bisect_left(bounds, x)] += n
    table = [(i, b, max(1, token_budget // max(b, 1)), -(-n // PART_ROWS)) for i, (b, n) in enumerate(zip(bounds, in_bucket, strict=True))]
    bucket = F.lit(0)
    for i, b in enumerate(bounds[:-1]):  # at most ``buckets`` cases
        bucket = F.when(F.col("padded") > b, F.lit(i + 1)).otherwise(bucket)
    info = spark.createDataFrame(table, "bucket int, bucket_len bigint, batch_rows bigint, parts int")
    rows = rows.withColumn("bucket", bucket.cast("int")).join(F.broadcast(info), "bucket")  # one row per bucket
    rows = rows.withColumn("hash", F.xxhash64("id", "row")).withColumn("part", F.pmod("hash", "parts").cast("int"))
    order = Window.partitionBy("bucket", "part").orderBy("hash", "row")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    local = F.expr("place div batch_rows")
    batch = F.concat_ws("-", F.col("bucket"), F.col("part"), local)
    return rows.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len", batch.alias("batch"),
        (F.col("place") % F.col("batch_rows")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("n_padding"),
    )
