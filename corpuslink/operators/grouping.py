"""Grouping, first-wins rules, running bests and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key, by a total order. Ranks are cut in each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def top_per_group(rows: DataFrame, keys: list[str], order: list[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def grouped(rows: DataFrame, key: Column, order: str, first: list[str], collect: str, most: int = 100) -> DataFrame:
    """Rows of one key: the first row's columns, the ``most`` least distinct values of ``collect``, and a count.

    Groups meet by a digest of the key, and the columns of the first row stay with it.
    """
    keyed = rows.withColumn("group_key", key).withColumn("_g", F.md5(F.coalesce("group_key", F.lit("")).cast("binary")))
    heads = first_per_key(keyed, ["_g"], [order]).select("_g", "group_key", *first)
    counts = keyed.groupBy("_g").agg(F.count("*").alias("n"))
    values = keyed.filter(F.col(collect).isNotNull()).select("_g", collect).distinct()
    lists = top_per_group(values, ["_g"], [collect], most, "_r").groupBy("_g").agg(F.array_sort(F.collect_list(collect)).alias(f"{collect}_set"))
    none = F.array().cast(lists.schema[f"{collect}_set"].dataType)
    return heads.join(counts, "_g").join(lists, "_g", "left").withColumn(f"{collect}_set", F.coalesce(f"{collect}_set", none)).drop("_g")


def running_best(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Each row that is replaced or refused, with the best of its key at that moment; ties keep the earlier."""
    state = F.max(F.struct(F.col(score), (-F.col(order)).alias("o"))).over(
        Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    best = rows.withColumn("keeper", -state["o"]).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    before = F.lag("keeper").over(Window.partitionBy(key).orderBy(order))
    return best.withColumn("lost", F.when(F.col("keeper") == F.col(order), before).otherwise(F.col(order))).filter("lost is not null")


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` up to each row of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def suffixed(rows: DataFrame, ident: str, order: str, name: str) -> DataFrame:
    """Repeated ids get their occurrence number."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(order))
    return rows.withColumn(name, F.when(n == 1, F.col(ident).cast("string")).otherwise(F.concat_ws("-", F.col(ident).cast("string"), n.cast("string"))))


def dense_ids(rows: DataFrame, order: str, name: str, start: int = 1, buckets: int = 256) -> DataFrame:
    """Sequential ids by ``order`` (an integer column) without one global window.

    Ranges between approximate quantiles are counted, the counts added up, and rows are numbered inside their range.
    """
    bounds = sorted(set(rows.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.001)))
    if not bounds:
        return rows.withColumn(name, F.lit(None).cast("long"))
    parts = rows.withColumn("_b", F.size(F.filter(F.lit([int(b) for b in bounds]).cast("array<long>"), lambda b: b < F.col(order))))
    counts = parts.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")  # at most `buckets` rows
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return parts.withColumn("_i", inside).join(F.broadcast(starts), "_b").withColumn(name, F.col("_start") + F.col("_i") + (start - 1)).drop("_b", "_i", "_start")


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Both, keeping one row a key: those of ``first`` before those of ``second``, each by ``order``."""
    both = first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)))
    return first_per_key(both, [key], ["source_rank", order])


def votes(rows: DataFrame, key: str, value: str, order: str, tie: str = "first") -> DataFrame:
    """Most frequent value of each key; ties: the first seen, or the smallest."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    second = -F.col("seen") if tie == "first" else -F.col(value)
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", second.alias("t"))).alias(value), F.max("n").alias("votes"))
