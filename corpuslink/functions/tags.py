"""Tags from dictionaries given as parameters. The dictionaries are small rule tables; for large ones join tokens instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def _has_word(lower: Column, word: str) -> Column:
    literal = "".join(c if c.isalnum() else f"\\{c}" for c in word)
    return lower.contains(word) & lower.rlike(rf"(?<![a-z0-9_]){literal}(?![a-z0-9_])")


def concepts(c: Column | str, names: list[str], most: int = 30) -> Column:
    """The ``names`` that the text holds, longest first: a name with a space anywhere, another as a whole word; ``most`` at most."""
    t = F.lower(text(c))
    ordered = sorted(dict.fromkeys(names), key=len, reverse=True)
    hits = [F.when(t.contains(n.lower()) if " " in n else _has_word(t, n.lower()), F.lit(n)) for n in ordered]
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


def alias_tags(c: Column | str, aliases: dict[str, str], category: Column | str | None = None, defaults: dict[str, list[str]] | None = None, most: int = 8) -> Column:
    """Tags of the ``aliases`` that the text contains, in the table's order, then the category's defaults; distinct, ``most`` at most."""
    t = F.lower(text(c))
    found = F.array_compact(F.array(*[F.when(t.contains(a), F.lit(tag)) for a, tag in aliases.items()]))
    if category is not None and defaults:
        cat, extra = text(category), F.array().cast("array<string>")
        for name, tags in defaults.items():
            extra = F.when(cat == name, F.array(*map(F.lit, tags))).otherwise(extra)
        found = F.concat(found, extra)
    return F.slice(F.array_distinct(found), 1, most)


def mentions(c: Column | str, kinds: list[tuple[str, str]], each: int = 20, most: int = 60) -> Column:
    """Typed mentions (kind, value) by pattern, in the order of ``kinds``; distinct values of a kind, ``each`` a kind, ``most`` in all."""
    t = text(c)
    lists = [
        F.transform(F.slice(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda x: F.trim(x))), 1, each), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        for kind, p in kinds
    ]
    return F.slice(F.flatten(F.array(*lists)), 1, most)


def segments(c: Column | str, heading: str, group: int = 1) -> Column:
    """Text from one heading to the next, as (n, heading, body); one segment without a heading if there is none.

    What stands before the first heading belongs to no segment.
    """
    t = text(c)
    heads, bodies = F.regexp_extract_all(t, F.lit(heading), F.lit(group)), F.split(t, heading)
    cut = F.transform(heads, lambda h, i: F.struct((i + 1).alias("n"), h.alias("heading"), F.get(bodies, i + 1).alias("body")))
    whole = F.array(F.struct(F.lit(1).alias("n"), F.lit(None).cast("string").alias("heading"), t.alias("body")))
    return F.when(F.size(heads) > 0, cut).otherwise(whole)
