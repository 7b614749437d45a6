"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a Column expression; no user functions run. The counts of a text come from its array
of words, its array of lines and one sort of its 3-word windows, all inside the row, so the operator
has no shuffle at all and a hot source or a long text only costs its own length times its logarithm.

Defined results: a null or empty text counts zero everywhere and fails the base rule; repeated rows
are judged one by one; an empty table gives an empty table; all other input columns are carried in
the struct column ``doc``, so their names can't clash with the measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that was for it with as on be at by this are or from his an they which had not but "
    "der die und das in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une du dans est que pour qui sur pas au par avec ce il sont plus en "
    "el los las y se del lo no con una su al es por como para"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject when ``measure / per`` lies outside [low, high]; ``per`` of zero counts as one."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        ratio = F.col(self.measure) / F.greatest(F.col(self.per), F.lit(1))
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (ratio < F.lit(self.low))
        if self.high is not None:
            bad = bad | (ratio > F.lit(self.high))
        return bad


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.15),
    Rule("exclamations", "n_exclamations", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("line_length", "n_words", "n_lines", low=1.5),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (all input columns) with the counts of its text."""
    held = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    start = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = start.select(
        "doc",
        (F.length("t") - held(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        held(SYMBOLS).cast("long").alias("n_symbols"),
        held("!").cast("long").alias("n_exclamations"),
        F.array_remove(F.split("t", f"{SPACE}+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("line"),
    )
    places = F.when(F.size("w") > 2, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    counted = parts.select(
        "doc", "word_chars", "n_symbols", "n_exclamations", "w",
        F.size("line").cast("long").alias("n_lines"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))).alias("s"),
    )
    # Windows of one hash are neighbours in the sorted array; their words are looked up only where hashes are equal.
    word = lambda x, k: F.get("w", x["i"] + k)
    same = F.zip_with(
        F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))),
        F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))),
        lambda x, y: F.when((x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.array(x["i"], y["i"])),
    )
    begins = counted.select(
        "doc", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))).alias("begin"),
    )
    # A window covers three words, fewer where the next one begins sooner.
    gaps = F.zip_with("begin", F.slice("begin", 2, F.greatest(F.size("begin"), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return begins.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("begin")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``measured`` with base_failed, the names of the rules broken, and kept."""
    m = measured(docs, text).withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
    )
    broken = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    return m.withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns.

    Catalyst would push a filter on ``kept`` below the projections and repeat their sorts in its condition for every use of a
    count. A row number is never negative, but not deterministic, so the filter stays above and each count is made once.
    """
    once = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return quality(docs, **options).select("doc", once.alias("kept")).filter("kept").select("doc.*")
