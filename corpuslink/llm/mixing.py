"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a random key, a hash of its id and text. Within a source the documents are ordered by
that key; the key's top bits name one of the ranges, about ``RANGE_ROWS`` documents each, so a prefix sum is the sum of the
ranges before (a small aggregate per source and range) plus a running sum inside one range. A hot
source is spread over all its ranges, and the sums are made before anything is shuffled. A source is
cut at its exact budget: whole epochs first, then the documents before the cut, the one at the cut in part.

Words are counted once, in a pass that writes a narrow table of (key, size, place). The mix joins the
ranges' sums with rows dealt by the same columns, so documents are shuffled once.

Defined results: a null or blank text has size 0 and is never taken; null is a source of its own,
last in order; with no words at all every target is 0; repeated rows are separate documents, in a
stable order of (key, id, size), equal ones as they come, which gives the same rows; other input columns are carried in the struct column ``doc``, so
their names can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 5_000


def sizes(text: str = "text"):
    """Words of a text as a Column."""
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(f"{SPACE}+")) + 1).cast("long")


def budgets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above max_epochs times its size.

    Giving what exceeds a ceiling to the others by weight until none is above ends at
    ``least(ceiling, level * weight)``: with the sources sorted by ceiling / weight, the level is the
    first at which all later ones fit. One row a source: a small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    rows = per_source.select("source", "source_size", w.alias("w"))
    rows = rows.withColumn("top", (F.col("source_size") * max_epochs).cast("double")).withColumn("at", F.col("top") / F.col("w"))
    by = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(whole)
    return rows.select(
        "source", "source_size", F.least(F.col("top"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target")
    )


def placed(docs: DataFrame, key: str, text: str, source: str, seed: int, keep: list[str] | None) -> DataFrame:
    """doc (the columns in ``keep``, all if None), source, sk (the source as a key without nulls), key, size, h (random key), bucket (its range)."""
    ranges = max(64, -(-docs.count() // RANGE_ROWS))
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    return docs.select(
        F.struct(*(docs[c] for c in keep or docs.columns)).alias("doc"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("sk"), F.col(key).alias("key"), sizes(text).alias("size"), h.alias("h"),
        F.coalesce(F.floor((h.cast("double") / 2.0**64 + 0.5) * ranges).cast("int"), F.lit(0)).alias("bucket"),
    )


def cuts(narrow: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row a source and range: sk, bucket, start (words before it in its source), source_size, target."""
    part = narrow.groupBy("source", "sk", "bucket").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select("sk", "bucket", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    goal = budgets(part.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("sk"), "source_size", "target")
    return starts.join(goal, "sk")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per document: doc (the columns in ``keep``, all if None), size, source_size, target, taken (words, repeats counted), before (its place)."""
    rows = placed(docs, key, text, source, seed, keep)
    if keep is not None:  # narrow rows: counted once, read twice
        rows = stored(rows, "sizes")
    fixed = stored(cuts(rows, weights, max_epochs), "cuts")
    inside = Window.partitionBy("sk", "bucket").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(fixed.hint("merge"), ["sk", "bucket"])
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    before = F.col("start") + F.col("run")
    rest = budget - full * F.col("source_size")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return joined.select(
        "doc",
        "size",
        "source_size",
        "target",
        (full * F.col("size") + part_taken).cast("long").alias("taken"),
        before.alias("before"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its epochs say; the one at a cut is taken whole."""
    m = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return (
        m.select("doc", copies.alias("copies")).filter("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("doc.*")
    )
