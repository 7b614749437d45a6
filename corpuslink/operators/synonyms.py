"""Synonym classes as a table: closed transitively, folded into token lists by a join, and signatures of what is left.

Defined results: a class goes by its least token; null and empty tokens have no class; pairs of equal tokens say nothing; token lists keep their
order and repeats; null lists are empty; an empty table of pairs folds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import settled


def classes(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(token, class): every token of ``pairs`` with the least token that it is linked to by any chain of pairs.

    Each round takes the least class among a token and its neighbours, and then the class of that class, until nothing moves.
    """
    good = (F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b))
    edges = pairs.filter(good).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = settled(edges.union(edges.select("y", "x")).distinct())
    known = settled(edges.groupBy(F.col("x").alias("token")).agg(F.least(F.col("token"), F.min("y")).alias("class")))
    while True:
        near = edges.join(known.select(F.col("token").alias("y"), F.col("class").alias("c")), "y").groupBy(F.col("x").alias("token")).agg(F.min("c").alias("c"))
        new = known.join(near, "token").select("token", F.least("class", "c").alias("new"), "class")
        jump = known.select(F.col("token").alias("new"), F.col("class").alias("next"))
        new = settled(new.join(jump, "new", "left").select("token", F.coalesce(F.least("new", "next"), F.col("new")).alias("new"), "class"))
        if new.filter("new != class").isEmpty():
            return new.select("token", "class")
        known = new.select("token", F.col("new").alias("class"))


def folded(rows: DataFrame, ident: str, toks: str, table: DataFrame) -> DataFrame:
    """``rows`` with the tokens of ``toks`` replaced by their classes (token, class), in place. ``ident`` must be unique."""
    each = rows.select(ident, F.posexplode(toks).alias("i", "token")).join(table, "token", "left")
    lists = each.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("class", "token").alias("t")))).alias("_f"))  # one row's tokens
    none = F.array().cast("array<string>")
    return rows.join(lists, ident, "left").withColumn(toks, F.coalesce(F.transform("_f", lambda x: x["t"]), none)).drop("_f")


def core(toks: Column, noise: list[str]) -> Column:
    """Tokens that say something about the subject: no ``noise``, no years."""
    return F.filter(toks, lambda t: ~t.isin(noise) & ~t.rlike("^[0-9]{4}$"))


def ordered_signature(toks: Column) -> Column:
    """Distinct tokens in their order, joined; empty where fewer than two are left."""
    own = F.array_distinct(toks)
    return F.when(F.size(own) >= 2, F.array_join(own, " ")).otherwise("")
