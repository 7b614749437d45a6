"""Calendar grids of daily counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """The Sunday on or before ``day``."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def intensity(n: Column) -> Column:
    """0 to 4, for none, one, up to three, up to six, more."""
    return F.when(n <= 0, 0).when(n == 1, 1).when(n <= 3, 2).when(n <= 6, 3).otherwise(4)


def grid(counts: DataFrame, key: str, today: Column, day: str = "day", n: str = "n", weeks: int = 18) -> DataFrame:
    """(key, day, week, n, level, label) for every day of the ``weeks`` weeks that end with today's, zero where nothing was counted.

    ``counts`` has one row a key and day. A label is the month's short name where a week's month differs from the week before,
    and in week 0. The days come from one small sequence; counts are joined by key and day.
    """
    start = F.date_sub(week_start(today), 7 * (weeks - 1))
    days = F.transform(F.sequence(F.lit(0), F.lit(7 * weeks - 1)), lambda i: F.date_add(start, i))
    keys = counts.select(key).distinct().select(key, F.posexplode(days).alias("i", day))
    first = F.date_sub(F.col(day), F.col("i") % 7)
    label = F.when((F.col("i") < 7) | (F.month(first) != F.month(F.date_sub(first, 7))), F.date_format(first, "MMM")).otherwise("")
    filled = F.coalesce(F.col(n), F.lit(0))
    return keys.join(counts, [key, day], "left").select(
        key, day, F.floor(F.col("i") / 7).cast("int").alias("week"), filled.alias(n), intensity(filled).alias("level"), label.alias("label")
    )


def totals(cells: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Per key of a grid: all actions, active days, and the last week's actions."""
    last = F.max("week").over(Window.partitionBy(key))
    rows = cells.withColumn("last", last)
    return rows.groupBy(key).agg(
        F.sum(n).alias("total"), F.count_if(F.col(n) > 0).alias("active_days"), F.sum(F.when(F.col("week") == F.col("last"), F.col(n)).otherwise(0)).alias("this_week")
    )
