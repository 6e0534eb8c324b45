"""Date coercion and the monthly / per-category aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import DATE_FORMATS, coerce_date


def with_month_year(df: DataFrame, date_col: str = "Date", formats=DATE_FORMATS) -> DataFrame:
    """Parse the date (bad values -> NULL) and add Month and Year."""
    parsed = F.col(date_col) if dict(df.dtypes)[date_col].startswith("timestamp") else coerce_date(date_col, formats)
    return df.withColumn(date_col, parsed).withColumn("Month", F.month(date_col)).withColumn("Year", F.year(date_col))


def count_per(df: DataFrame, key: str) -> DataFrame:
    """Rows per key; rows with a missing key are not counted (years merge
    when the key is Month)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("Count"))


def share_of_total(counts: DataFrame, count_col: str = "Count", out_col: str = "Percent") -> DataFrame:
    """Percent of the total per row. The input is an aggregate (one row per
    category), so the unpartitioned window runs over a handful of rows."""
    return counts.withColumn(out_col, 100.0 * F.col(count_col) / F.sum(count_col).over(Window.partitionBy()))
