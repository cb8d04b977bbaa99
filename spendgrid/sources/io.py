"""Sources and sinks (S1-S3, S6, S8, S9, S12 builds on operators.snapshots).

Readers declare or clean schemas; writers go through ``DataFrameWriter``. Nothing is
collected: reports are nested with ``collect_list`` per bounded group and written by
Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid.functions.text import strip_ws


def read_grain(spark: SparkSession, base: str, alias: str) -> DataFrame:
    """Lazy columnar scan of one materialised grain; filters and projections applied
    to the result are pushed into the parquet scan by Catalyst."""
    return spark.read.parquet(f"{base.rstrip('/')}/{alias}")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a DataFrame to ``spark.sql`` under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def read_clean_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: CSV with header; header names and string cells are trimmed. With a schema,
    columns are cast to it by (trimmed) name after reading as text."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = raw.toDF(*[c.strip() for c in raw.columns])
    df = df.select(*[strip_ws(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def read_text_corpus(spark: SparkSession, root: str, exts=(".md", ".py"), ignore=(".git", "__pycache__")) -> DataFrame:
    """Recursive text scan: files with the given extensions, listed directories
    skipped, undecodable bytes dropped, path kept relative to ``root``.

    Extensions are a glob filter of the file listing. The listed names alone tell which
    directories are ignored; only the others are then loaded, so no skipped file is opened.
    ``binaryFile`` keeps the raw bytes of a file; ``make_valid_utf8`` marks malformed sequences
    with U+FFFD, which are then removed.
    """
    root = root.rstrip("/")
    glob = "{" + ",".join("*" + e for e in exts) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    listed = files.option("recursiveFileLookup", "true").load(root)
    bare = re.sub(r"^file:(//)?", "", root)
    path = F.regexp_replace(F.col("path"), r"^file:(//)?", "")
    rel = F.regexp_replace(path, "^" + re.escape(bare) + "/?", "")
    ignored = F.lit(False)
    for d in ignore:
        ignored = ignored | rel.rlike(r"(^|/)" + re.escape(d) + "(/|$)")
    # directory names, as the listing has them: the content column is not read
    folders = listed.filter(~ignored).select(F.regexp_replace("path", r"/[^/]*$", "").alias("d")).distinct()
    folders = [r["d"] for r in folders.collect()]
    text = F.translate(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    df = files.option("recursiveFileLookup", "false").load(folders) if folders else listed.limit(0)
    return df.filter(~ignored).select(rel.alias("path"), text.alias("text"))


def export_csv(df: DataFrame, path: str, id_prefix: dict[str, str] | None = None, dp: int = 2) -> str:
    """CSV export: doubles rounded to ``dp`` decimals, optional ``"<id> · <name>"``
    columns (``id_prefix`` maps a name column to its id column), header row."""
    out = df
    for name, idc in (id_prefix or {}).items():
        out = out.withColumn(name, F.concat(F.col(idc).cast("string"), F.lit(" · "), F.col(name)))
    out = out.select(*[F.round(c, dp).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_report_json(facts: DataFrame, path: str, smr: int, forecast_rule: str = "remaining_plan") -> DataFrame:
    """One JSON report: KPIs, weekly arrays, per-division figures with nested
    territories, per-group accounts with vs_plan / vs_aa; money rounded to 1 dp.

    Each nested list is a ``collect_list`` over an already aggregated, bounded group
    (weeks, divisions, territories of a division, accounts of a group).
    """
    r1 = lambda c: F.round(F.col(c).cast("double"), 1)
    ytd = facts.filter(F.col("sem") <= smr)
    k = ytd.agg(F.sum("real").alias("real"), F.sum("real_py").alias("prior"), F.sum("plan").alias("plan"))
    rest = facts.filter(F.col("sem") > smr).agg(F.sum("plan").alias("rest"))
    fc_extra = rest.select("rest").scalar() if forecast_rule == "remaining_plan" else k.select("plan").scalar() * 0.35
    kpis = k.select(F.struct(r1("real").alias("real"), r1("prior").alias("prior"), r1("plan").alias("plan"),
                             F.round((F.col("real") - F.col("prior")).cast("double"), 1).alias("vs_aa"),
                             F.round((F.col("real") - F.col("plan")).cast("double"), 1).alias("vs_plan"),
                             F.round((F.col("real") + fc_extra).cast("double"), 1).alias("forecast")).alias("kpis"))
    wk = facts.groupBy("sem").agg(*[F.sum(m).alias(m) for m in ("real_py", "plan", "real")])
    weeks = wk.agg(F.array_sort(F.collect_list(F.struct("sem", r1("real_py").alias("prior"), r1("plan").alias("plan"),
                                                          F.when(F.col("sem") <= smr, r1("real")).alias("real")))).alias("weeks"))
    ter = ytd.groupBy("division", "territorio").agg(F.sum("real").alias("real"), F.sum("plan").alias("plan"))
    div = ter.groupBy("division").agg(
        F.sum("real").alias("real"), F.sum("plan").alias("plan"),
        F.array_sort(F.collect_list(F.struct("territorio", r1("real").alias("real"), r1("plan").alias("plan")))).alias("territories"),
    )
    divisions = div.agg(F.array_sort(F.collect_list(F.struct("division", r1("real").alias("real"), r1("plan").alias("plan"),
                                                              "territories"))).alias("divisions"))
    acc = ytd.groupBy("grupo", "cuenta").agg(*[F.sum(m).alias(m) for m in ("real_py", "plan", "real")])
    grp = acc.groupBy("grupo").agg(
        F.sum("real").alias("real"),
        F.array_sort(F.collect_list(F.struct(
            "cuenta", r1("real").alias("real"),
            F.round((F.col("real") - F.col("plan")).cast("double"), 1).alias("vs_plan"),
            F.round((F.col("real") - F.col("real_py")).cast("double"), 1).alias("vs_aa")))).alias("accounts"),
    )
    groups = grp.agg(F.array_sort(F.collect_list(F.struct("grupo", r1("real").alias("real"), "accounts"))).alias("groups"))
    report = kpis.withColumn("weeks", weeks.select("weeks").scalar()) \
        .withColumn("divisions", divisions.select("divisions").scalar()) \
        .withColumn("groups", groups.select("groups").scalar())
    report.coalesce(1).write.mode("overwrite").json(path)
    return report
