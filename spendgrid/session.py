"""Session helpers: a local session for tests/bench, and the shared checkpoint folder.

Library functions never create a session; they take DataFrames. These helpers are
only for entry points (tests, bench, examples).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spendgrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets one of its own, below a fresh
    temporary folder; on a cluster a machine-local folder would not be shared, so that raises.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():  # Spark's own folder below the named one, made once
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {sc.master})")
        d = tempfile.mkdtemp(prefix="spendgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, below a folder of this application in the
    shared checkpoint folder; ``clear_scratch`` removes them all."""
    return os.path.join(_scratch_root(spark), f"{name}-{os.urandom(6).hex()}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the shared checkpoint folder and read back: what is
    computed once (a partition number, a row number) is the same for every later reader."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more, or a folder of them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_version(spark: SparkSession, path: str) -> tuple:
    """The path with the number and one hash of names, sizes and modification times of its data
    files: it changes when a table is rewritten. From the file listing alone; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    return (path, *files.agg(F.count(F.lit(1)), F.expr("bit_xor(h)")).first())


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no DataFrame needs them any more."""
    delete(spark, _scratch_root(spark))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
