"""Dated file names and day-by-day gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_FORMAT = "yyyy_MM_dd"


def file_name(template: str, day: Column) -> Column:
    """`template` with its `{}` replaced by the day."""
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), F.date_format(day, DAY_FORMAT), F.lit(tail))


def daily_files(spans: DataFrame, template: str) -> DataFrame:
    """For each `(end_date, n)`: `n` days back from the end date, with a file name per day.

    `n` of zero or less gives no rows.
    """
    offsets = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - F.lit(1)))
    days = spans.select("end_date", F.explode(offsets).alias("back"))
    days = days.select(F.date_sub("end_date", F.col("back")).alias("day"))
    return days.select("day", file_name(template, F.col("day")).alias("file_name"))


def _spine(df: DataFrame, end_date: str, n: int) -> DataFrame:
    days = df.sparkSession.range(max(n, 0))
    return days.select(F.date_sub(F.lit(end_date).cast("date"), F.col("id").cast("int")).alias("day"))


def _counts(df: DataFrame, ts: str, end_date: str, n: int) -> DataFrame:
    end = F.lit(end_date).cast("date")
    # A range on the raw column, so that it reaches the scan; the day is cut out after it.
    recent = df.where((F.col(ts) >= F.date_sub(end, n - 1)) & (F.col(ts) < F.date_add(end, 1)))
    return recent.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("cnt"))


def daily_gapfill(df: DataFrame, ts: str, end_date: str, n: int) -> DataFrame:
    """`(day, cnt)` for the last `n` days up to `end_date`; days without rows count 0."""
    joined = _spine(df, end_date, n).join(_counts(df, ts, end_date, n), "day", "left")
    return joined.select("day", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def daily_missing(df: DataFrame, ts: str, end_date: str, n: int) -> DataFrame:
    """Days of the last `n` that have no rows."""
    return _spine(df, end_date, n).join(_counts(df, ts, end_date, n), "day", "left_anti")
