"""Themes of rows as a graph: entities with their subjects, the bridge table, and theme-to-theme edges through shared rows.

A row's pairs of themes are made inside the row and summed before the shuffle, so a theme that a third of all rows have is no hot key;
a row with many themes goes out theme by theme, so that no task holds all its pairs at once. What an edge weighs falls with the
number of themes that its rows have: a row with k themes gives each of its pairs 1 / (k - 1).

Defined results: themes are trimmed and in lower case, empty and null ones are left out, a row's repeated themes count once; null subjects aren't in
subject sets; repeated ids are one row with the union of its themes where bridges are made; rows without themes give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grouping import top_per_group


def cleaned(themes: str) -> Column:
    """Distinct themes of a row, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(themes, lambda x: F.trim(F.lower(x))), lambda x: x.isNotNull() & (x != ""))))


def theme_id(name: str = "name") -> Column:
    return F.concat(F.lit("theme_"), F.substring(F.sha2(F.col(name), 256), 1, 12))


def theme_bridges(rows: DataFrame, ident: str, themes: str) -> DataFrame:
    """(theme_id, name, ident): which theme is in which row, once each."""
    each = rows.select(ident, F.explode(cleaned(themes)).alias("name")).distinct()
    return each.select(theme_id().alias("theme_id"), "name", ident)


def theme_entities(rows: DataFrame, ident: str, themes: str, subject: str) -> DataFrame:
    """(theme_id, name, n, subjects, cross): rows with the theme, the sorted set of their subjects, and whether these are several."""
    each = rows.select(ident, T.text(subject).alias("_s"), F.explode(cleaned(themes)).alias("name"))
    # A subject list has as many entries as there are subjects; counts and subjects are told apart before they meet.
    kinds = each.filter("_s != ''").select("name", "_s").distinct().groupBy("name").agg(F.sort_array(F.collect_list("_s")).alias("subjects"))
    counts = each.groupBy("name").agg(F.count_distinct(ident).alias("n"))
    both = counts.join(kinds, "name", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))
    return both.select(theme_id().alias("theme_id"), "name", "n", "subjects", (F.size("subjects") > 1).alias("cross"))


def theme_graph(rows: DataFrame, ident: str, themes: str) -> DataFrame:
    """(a, b, shared, weight): pairs of themes with a < b, how many rows share them, and the sum of the rows' 1 / (themes - 1)."""
    lists = rows.select(ident, F.explode(cleaned(themes)).alias("name")).distinct().groupBy(ident).agg(F.sort_array(F.collect_list("name")).alias("t"))  # one row's themes
    lists = lists.withColumn("k", F.size("t")).filter("k > 1")
    lefts = lists.select("t", "k", F.posexplode("t").alias("i", "a"))
    pairs = lefts.select("a", "k", F.explode(F.slice("t", F.col("i") + 2, F.greatest(F.col("k") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(1 / (F.col("k") - 1)).alias("weight"))


def neighbours(graph: DataFrame, most: int) -> DataFrame:
    """(name, other, shared, weight, rank): the ``most`` heaviest neighbours of each theme, either way along an edge, ties by name."""
    both = graph.select(F.col("a").alias("name"), F.col("b").alias("other"), "shared", "weight").unionByName(graph.select(F.col("b").alias("name"), F.col("a").alias("other"), "shared", "weight"))
    return top_per_group(both, ["name"], [F.desc(F.round("weight", 9)), "other"], most)
