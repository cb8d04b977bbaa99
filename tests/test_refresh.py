"""Incremental refresh: only what changed is read, and the sums are those of the files that are there."""

import os
import shutil

from pyspark.sql import functions as F

from spendgrid.operators.refresh import refresh_aggregate

SCHEMA = "k string, v decimal(10,2)"


def test_added_changed_and_removed_files(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "sums")

    def arrive(name, rows):
        spark.createDataFrame([(k, v) for k, v in rows], "k string, v double").selectExpr("k", "cast(v AS decimal(10,2)) AS v").coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")

    def refresh():
        r = refresh_aggregate(spark, src, target, ["k"], ["v"], SCHEMA)
        return {x.k: float(x.v) if x.v is not None else None for x in r.aggregate.collect()}, len(r.read), r.dropped

    assert refresh() == ({}, 0, 0)
    for i in range(6):
        arrive(f"f{i}", [("a", 1.5), ("b", float(i)), (None, 0.25)])
    arrive("none", [])
    sums, read, dropped = refresh()
    assert sums == {"a": 9.0, "b": 15.0, None: 1.5} and dropped == 0 and 6 <= read <= 7
    assert refresh() == (sums, 0, 0)
    arrive("f3", [("a", 100.0), ("c", None)])
    sums, read, dropped = refresh()
    assert (sums, read, dropped) == ({"a": 107.5, "b": 12.0, "c": None, None: 1.25}, 1, 1)
    shutil.rmtree(f"{src}/f0")
    arrive("f9", [("c", 7.0)])
    assert refresh() == ({"a": 106.0, "b": 12.0, "c": 7.0, None: 1.0}, 1, 1)
    shutil.rmtree(src)
    assert refresh()[0] == {}


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """Files that a refresh has summed may become unreadable without their size and time changing."""
    src, target = str(tmp_path / "src"), str(tmp_path / "sums")
    for i in range(3):
        spark.range(10).selectExpr("cast(id % 2 AS string) AS k", "cast(1 AS decimal(10,2)) AS v").coalesce(1).write.parquet(f"{src}/f{i}")
    prepare = lambda df: df.filter(F.col("k") == "1")
    refresh_aggregate(spark, src, target, ["k"], ["v"], SCHEMA, prepare)
    for folder, _, files in os.walk(src):
        for f in files:
            if f.endswith(".parquet"):
                p = os.path.join(folder, f)
                stat = os.stat(p)
                with open(p, "r+b") as broken:
                    broken.write(b"\0" * stat.st_size)
                os.utime(p, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    spark.range(4).selectExpr("cast(id % 2 AS string) AS k", "cast(1 AS decimal(10,2)) AS v").coalesce(1).write.parquet(f"{src}/late")
    r = refresh_aggregate(spark, src, target, ["k"], ["v"], SCHEMA, prepare)
    assert len(r.read) == 1 and [(x.k, float(x.v)) for x in r.aggregate.collect()] == [("1", 17.0)]


def test_arriving_line_items_are_written_by_many_tasks(spark, tmp_path):
    """s12: a folder of line items is not squeezed into one file, and the sums are whole."""
    import glob

    from spendgrid.plans.registry import queries

    src = str(tmp_path / "sf")
    rows = spark.range(0, 400, 1, 4).selectExpr("id AS l_orderkey", "'R' AS l_returnflag", "'F' AS l_linestatus", "CAST(2 AS DECIMAL(15,2)) AS l_quantity")
    rows.write.parquet(f"{src}/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = queries()["s12_refreshed_aggregate"](spark, src).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.qty, r.n) for r in got] == [(600, 300)]
    newest = max(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables/*/refresh-src-*"), key=__import__("os").path.getmtime)
    assert len(glob.glob(newest + "/p0/*.parquet")) > 1
