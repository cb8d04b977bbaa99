"""Incremental refresh of additive aggregates over a folder of files.

Beside an aggregate lie the partial sums of every source file, in one folder per file version. A
version is a hash of the file's path, size and modification time, so the folders are the manifest:
a refresh reads the files whose version has none, drops the folders of versions that are gone, and
adds the partial sums up. What changed is read; what did not is not opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FOLDER = "file_version="


@dataclass
class Refreshed:
    aggregate: DataFrame  # the keys and sums over all files
    read: list[str]  # files that were read now
    dropped: int  # versions whose partial sums were dropped


def _versions(spark: SparkSession, source: str) -> dict[int, str]:
    """Version and path of every data file below ``source``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    rows = files.select("path", F.xxhash64("path", "length", "modificationTime").alias("v")).collect()  # one row per file
    return {r["v"]: r["path"] for r in rows}


def refresh_aggregate(spark: SparkSession, source: str, target: str, keys: list[str], sums: list[str], schema,
                      prepare: Callable[[DataFrame], DataFrame] | None = None) -> Refreshed:
    """``keys`` and the sum of each column of ``sums`` over all Parquet files below ``source``.

    ``target`` holds the partial sums of earlier refreshes (none at first). ``schema`` is that of the
    files; ``prepare`` makes the rows to sum from theirs, row by row or by lookups that do not
    change, and keeps the column ``file_version``. Sums should be decimals or integers: the way they
    are added up then does not show. Files may be added, rewritten or removed between refreshes;
    one refresh runs at a time. One that fails commits nothing and is run again. An empty or missing
    folder gives no rows.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    here, at = path(source), path(target)
    fs = at.getFileSystem(conf)
    now = _versions(spark, source) if here.getFileSystem(conf).exists(here) else {}
    folders = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    held = {int(f.removeprefix(FOLDER)) for f in folders if f.startswith(FOLDER)}
    new, gone = sorted(set(now) - held), sorted(held - set(now))
    prepare = prepare or (lambda df: df)
    add = [F.sum(c).alias(c) for c in sums]

    def partial(rows):
        return prepare(rows).groupBy("file_version", *keys).agg(*add, F.count(F.lit(1)).alias("file_rows"))

    if new:
        names = spark.createDataFrame([(now[v], v) for v in new], "file_path string, file_version bigint")
        rows = spark.read.schema(schema).parquet(*[now[v] for v in new])
        rows = rows.withColumn("file_path", F.col("_metadata.file_path")).join(names, "file_path").drop("file_path")
        # a file without rows to sum gets its folder too, or it would be read again
        parts = names.select("file_version").join(partial(rows), "file_version", "left")
        parts.repartition("file_version").write.mode("append").partitionBy("file_version").parquet(target)
    for v in gone:
        fs.delete(path(f"{target}/{FOLDER}{v}"), True)
    blank = partial(spark.createDataFrame([], schema).withColumn("file_version", F.lit(0).cast("bigint")))
    parts = spark.read.schema(blank.schema).parquet(target) if now else blank
    whole = parts.filter("file_rows IS NOT NULL").groupBy(*keys).agg(*[F.sum(c).cast(blank.schema[c].dataType).alias(c) for c in sums])
    return Refreshed(whole, [now[v] for v in new], len(gone))
