"""Walks over JSON of unknown shape: explode steps over VARIANT, level by level, until none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rounds import settled


def _first(names: list[str]) -> Column:
    """First non-empty string under one of ``names``."""
    return F.coalesce(*[F.nullif(F.try_variant_get("node", f"$.{n}", "string"), F.lit("")) for n in names])


def harvested(rows: DataFrame, ident: str, body: str, question: list[str], name: list[str], link: list[str], depth: int | None = None, ahead: int = 6) -> DataFrame:
    """Distinct (ident, question, name, link) of all objects, however deep, that have a name and a link; with ``depth``, of so many levels.

    An object without a question of its own takes its nearest ancestor's. Text that is no JSON gives nothing. Each level is one
    ``variant_explode``, a narrow step; the only shuffle is the distinct at the end. After every ``ahead`` levels the nodes that are left are stored, and
    the walk ends where there are none, so a plan has ``ahead`` levels at most.
    """
    level = rows.select(ident, F.try_parse_json(body).alias("node"), F.lit(None).cast("string").alias("up")).filter("node is not null")
    found, done = None, 0
    while depth is None or done < depth:
        if done and done % ahead == 0:
            level = settled(level.select(ident, F.to_json("node").alias("node"), "up")).select(ident, F.parse_json("node").alias("node"), "up")
            if level.isEmpty():
                break
        is_object = F.schema_of_variant("node").startswith("OBJECT")
        own = F.when(is_object, F.coalesce(_first(question), F.col("up"))).otherwise(F.col("up"))
        here = level.select(ident, "node", own.alias("question"), F.when(is_object, _first(name)).alias("name"), F.when(is_object, _first(link)).alias("link"))
        hit = here.filter("question is not null and name is not null and link is not null").select(ident, "question", F.trim("name").alias("name"), "link")
        found = hit if found is None else found.unionByName(hit)
        nested = here.filter(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
        level = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("node").outer()).select("value")).select(ident, F.col("value").alias("node"), F.col("question").alias("up"))
        done += 1
    return found.distinct()
