"""Prices' changes and discounts, dates and durations on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHANGE = 9999.9999


def change_pct(current: Column, previous: Column) -> Column:
    """Percent from the previous price, four decimals; null without a positive previous price or beyond the bound."""
    now, before = current.cast("double"), previous.cast("double")
    pct = (current - previous).cast("double") / before * 100
    return F.when((before > 0) & now.isNotNull(), F.when(F.abs(pct) <= MAX_CHANGE, F.round(pct, 4)))


def discount_pct(original: Column, current: Column) -> Column:
    """Percent off the original price, two decimals; null unless both are positive and the original is greater."""
    pct = (original - current).cast("double") / original.cast("double") * 100
    return F.when((original > 0) & (current > 0) & (original > current), F.floor(pct * 100 + 0.5) / 100)


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The date dimension from ``first`` to ``last`` (ISO dates)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    return date_rows(days, "d")


def date_rows(days: DataFrame, column: str) -> DataFrame:
    """The date dimension's rows of the dates in a column."""
    d = F.col(column)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.weekofyear(d).alias("iso_week"),
        (F.weekday(d) + 1).alias("iso_weekday"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        (d == F.last_day(d)).alias("is_month_end"),
    )


def month_bounds(date_id: Column, ahead: int = 0) -> tuple[Column, Column]:
    """First date_id of the month ``ahead`` months later, and of the one after it."""
    first = F.trunc(F.to_date(date_id.cast("string"), "yyyyMMdd"), "month")
    as_id = lambda d: F.date_format(d, "yyyyMMdd").cast("int")
    return as_id(F.add_months(first, ahead)), as_id(F.add_months(first, ahead + 1))


def duration_seconds(duration_ms: Column, started: Column, completed: Column) -> Column:
    """Seconds with three decimals, from the measured milliseconds or else from the two instants."""
    span = (F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))).cast("double") / 1e6
    return F.coalesce(F.floor(duration_ms.cast("double") + 0.5) / 1000, F.floor(span * 1000 + 0.5) / 1000)


def ago_bucket(then: Column, now: Column) -> Column:
    """How long ago, in words: seconds, minutes, hours, days, or the date after a week."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    whole = lambda unit: F.floor(seconds / unit + 0.5).cast("long").cast("string")
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(F.floor(seconds / 60 + 0.5) < 60, F.concat(whole(60), F.lit("m ago")))
        .when(F.floor(seconds / 3600 + 0.5) < 24, F.concat(whole(3600), F.lit("h ago")))
        .when(F.floor(seconds / 86400 + 0.5) < 7, F.concat(whole(86400), F.lit("d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
