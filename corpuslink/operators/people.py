"""Person names: matching keys, votes of the copies that share a source, and a lookup filled by sources in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text


def file_name_text(c: Column | str) -> Column:
    """A file name as words: its ending and download prefix out, dashes and underscores to spaces."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\.pdf$", ""), "^drive_", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[-_]", " "), r"\s+", " "))


def name_key(c: Column | str, noise: list[str]) -> Column:
    """Matching key of a name: ranks, years and ``noise`` words out, ASCII letters and ``.'-`` kept, lower case."""
    t = F.regexp_replace(text(c), r"(?i)(?<![A-Za-z0-9_])(?:air|rank)\s*[0-9]+(?![A-Za-z0-9_])", " ")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9_])[0-9]{4}(?![A-Za-z0-9_])", " ")
    t = F.regexp_replace(t, rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(noise)})(?![A-Za-z0-9_])", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[^A-Za-z .'-]", " "), " +", " ")
    return F.lower(F.trim(t))


def letters_key(c: Column | str) -> Column:
    """ASCII letters only, lower case."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z]", "")


def weighted_votes(rows: DataFrame, key: str, name: str, weight: Column, label: str) -> DataFrame:
    """(key, label, score, hits): the name of most weight for each key; ties by hits, then by the smaller name.

    Null and empty names don't vote. Both sums are partial before their shuffle, so a key with very many rows is no burden.
    """
    cast = rows.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(key, F.col(name).alias(label)).agg(F.sum(weight).alias("score"), F.count("*").alias("hits"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("hits")).alias("h"), F.col(label).alias("n"))
    best = cast.groupBy(key).agg(F.min_by(F.struct(label, "score", "hits"), order).alias("b"))
    return best.select(key, f"b.{label}", "b.score", "b.hits")


def first_or_ranked(sources: list[tuple[str, DataFrame]], key: str, order: str, rank: str, year: str) -> DataFrame:
    """(key, rank, year, source): the first row of each key over the named sources in their order, but a row with a rank goes
    before all without one. Rows with neither rank nor year say nothing. Missing is null or 0."""
    parts = []
    for i, (label, df) in enumerate(sources):
        parts.append(df.select(key, F.nullif(rank, F.lit(0)).alias("rank"), F.nullif(year, F.lit(0)).alias("year"), F.lit(label).alias("source"), F.lit(i).alias("src"), F.col(order).alias("ord")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(F.col(key).isNotNull() & (F.col("rank").isNotNull() | F.col("year").isNotNull()))
    first = F.min_by(F.struct("rank", "year", "source"), F.struct(F.col("rank").isNull().alias("none"), "src", "ord"))
    return rows.groupBy(key).agg(first.alias("f")).select(key, "f.rank", "f.year", "f.source")
