"""Fiscal calendar.

Weeks are seven days long. Week 1 of year ``y`` starts on the Sunday on or before
1 January; week ``s`` covers ``anchor + 7(s-1) .. anchor + 7(s-1) + 6``. Days falling in
a neighbouring year are dropped, so a week's fractions per month are ``days / 7`` of
its own-year days only. The calendar is a tiny (<= 53 x 2 rows per year) table built
with ``sequence``; callers broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def anchor_of(year_col: Column) -> Column:
    """Sunday on or before 1 January of ``year_col``."""
    jan1 = F.make_date(year_col, F.lit(1), F.lit(1))
    return F.date_sub(jan1, F.dayofweek(jan1) - 1)


def fiscal_week(date_col: Column) -> Column:
    """Week number (1..53) of a date within its own calendar year."""
    d = date_col.cast("date")
    return (F.floor(F.datediff(d, anchor_of(F.year(d))) / 7) + 1).cast("int")


def calendar_for(years: DataFrame) -> DataFrame:
    """F1 for every year in ``years(year INT)``: rows (year, sem, month, days, frac).

    Each year expands to 371 days (53 weeks) from its anchor; days outside the year are
    dropped, so ``frac = days / 7`` counts own-year days only.
    """
    anchor = anchor_of(F.col("year"))
    days = years.select(
        F.col("year").cast("int").alias("year"),
        F.explode(F.sequence(anchor, F.date_add(anchor, 53 * 7 - 1))).alias("d"),
    )
    return (
        days.select(
            "year",
            (F.floor(F.datediff("d", anchor_of(F.col("year"))) / 7) + 1).cast("int").alias("sem"),
            F.month("d").alias("month"),
            F.year("d").alias("y"),
        )
        .filter(F.col("y") == F.col("year"))
        .groupBy("year", "sem", "month")
        .agg(F.count("*").cast("int").alias("days"))
        .withColumn("frac", F.col("days") / F.lit(7.0))
    )


def week_calendar(spark: SparkSession, year: int) -> DataFrame:
    """the calendar of one year."""
    return calendar_for(spark.range(1).select(F.lit(year).alias("year")))


def month_weeks(cal: DataFrame) -> DataFrame:
    """first and last week touching each (year, month) of a calendar."""
    return cal.groupBy("year", "month").agg(F.min("sem").alias("first_sem"), F.max("sem").alias("last_sem"))


def split_weeks(cal: DataFrame) -> DataFrame:
    """weeks touching two months, with own-year days and percent in each."""
    multi = cal.groupBy("year", "sem").agg(F.count("*").alias("n_months")).filter("n_months > 1")
    return cal.join(multi.select("year", "sem"), ["year", "sem"], "left_semi").select(
        "year", "sem", "month", "days", F.round(F.col("days") / 7 * 100, 4).alias("pct")
    )


def month_days_by_week(spark: SparkSession, year: int, months) -> DataFrame:
    """(sem, days) = own-year days of week ``sem`` that fall in any of ``months``."""
    months = [int(m) for m in ([months] if isinstance(months, int) else months)]
    return (
        week_calendar(spark, year)
        .filter(F.col("month").isin(months))
        .groupBy("sem")
        .agg(F.sum("days").cast("int").alias("days"))
    )
