"""Placing rows in a taxonomy: the best node by tags and text, the best of a fallback subject, or a node made for the row.

A taxonomy is a small table of its own (``MOST_NODES`` rows at most, checked); it is gathered into one row, sent to the
executors, and searched inside each row. So the rows to place are neither multiplied nor shuffled, whatever their number.

Defined results: null tags, texts and labels count as empty and match nothing; of equal scores the node of lower ``ord`` wins; with no
subjects all nodes are searched; an empty taxonomy places every row in a node made for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_NODES = 20_000
#: Weights of a placement score and of a partial text match, bonuses, and least scores.
TAG, QUESTION, HINT, PAPER = 0.76, 0.24, 0.08, 0.04
CONTAINED, COVERAGE, JACCARD = 0.82, 0.72, 0.28
LEAST, LEAST_WITHIN = 0.42, 0.18


def label_normalise(c: Column | str, noise: list[str]) -> Column:
    """Lower case without brackets, quotes, dashes, the words in ``noise``, roman and other numerals."""
    t = F.regexp_replace(F.lower(T.text(c)), "[`'\".,()\\[\\]{}/-]+", " ")
    word = lambda inner: f"(?<![A-Za-z0-9_])(?:{inner})(?![A-Za-z0-9_])"
    for inner in ("|".join(noise), "[ivx]+", "[0-9]+"):
        t = F.regexp_replace(t, word(inner), " ") if inner else t
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def matchable(c: Column | str, noise: list[str], stop: list[str]) -> Column:
    """struct(n, t): the normalised text and its tokens of three characters or more that are no stop words; repeats stay."""
    n = label_normalise(c, noise)
    return F.struct(n.alias("n"), F.filter(F.split(n, " "), lambda x: (F.length(x) > 2) & ~x.isin(stop)).alias("t"))


def text_match(a: Column, b: Column) -> Column:
    """Of two ``matchable`` structs: 1 if equal, less if one holds the other, else coverage of the shorter and Jaccard; 0 if either is empty.

    Shared are the tokens of the first that the second has, repeats counted.
    """
    shared = F.size(F.filter(a["t"], lambda x: F.array_contains(b["t"], x))).cast("double")
    x, y = F.size(a["t"]), F.size(b["t"])
    part = shared / F.greatest(F.lit(1), F.least(x, y)) * COVERAGE + shared / F.greatest(F.lit(1), x + y - shared) * JACCARD
    return (
        F.when((a["n"] == "") | (b["n"] == ""), 0.0).when(a["n"] == b["n"], 1.0)
        .when(a["n"].contains(b["n"]) | b["n"].contains(a["n"]), CONTAINED).otherwise(part)
    )


def gathered(nodes: DataFrame, noise: list[str], stop: list[str]) -> DataFrame:
    """One row: the nodes (node_id, subject, label, paper, ord) as an array; raises ValueError beyond MOST_NODES."""
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"a taxonomy has at most {MOST_NODES} nodes")
    one = F.struct("ord", "node_id", "subject", matchable("label", noise, stop).alias("label"), label_normalise("paper", noise).alias("paper"))
    return nodes.agg(F.sort_array(F.collect_list(one)).alias("_nodes"))


def placed(rows: DataFrame, nodes: DataFrame, tags: str, question: str, subjects: str, hint: str, fallback: str, noise: list[str], stop: list[str]) -> DataFrame:
    """``rows`` with node_id, subject, score and stage (matched, within, made).

    ``tags`` and ``subjects`` are arrays: candidate tags, and the subjects to search; ``hint`` is the subject that earns a bonus,
    ``fallback`` the one to search when no node of the first search scores LEAST.
    """
    none = F.array().cast("array<string>")
    ready = rows.select(
        F.struct("*").alias("row"),
        F.transform(F.coalesce(F.col(tags), none), lambda x: matchable(x, noise, stop)).alias("tags"),
        matchable(question, noise, stop).alias("q"),
        F.coalesce(F.col(subjects), none).alias("pool"),
        F.col(hint).alias("hint"),
        F.col(fallback).alias("fallback"),
    ).join(F.broadcast(gathered(nodes, noise, stop)))  # one row of checked size

    def best(keep, hinted: Column) -> Column:
        def score(n: Column) -> Column:
            tag = F.aggregate("tags", F.lit(0.0), lambda a, x: F.greatest(a, text_match(x, n["label"])))
            bonus = F.when(n["subject"] == hinted, HINT).otherwise(0.0) + F.when(F.col("q")["n"].contains(n["paper"]), PAPER).otherwise(0.0)
            return F.round(tag * TAG + text_match(F.col("q"), n["label"]) * QUESTION + bonus, 9)

        found = F.transform(F.filter("_nodes", keep), lambda n: F.struct(score(n).alias("score"), (-n["ord"]).alias("o"), n["node_id"].alias("node_id"), n["subject"].alias("subject")))
        return F.array_max(found)

    first = ready.withColumn("first", best(lambda n: (F.size("pool") == 0) | F.array_contains("pool", n["subject"]), F.col("hint")))
    weak = F.col("first").isNull() | (F.col("first")["score"] < LEAST)
    second = first.withColumn("second", F.when(weak, best(lambda n: n["subject"] == F.col("fallback"), F.col("fallback"))))
    stage = F.when(~weak, "matched").when(F.col("second")["score"] >= LEAST_WITHIN, "within").otherwise("made")
    label = F.coalesce(F.get(F.col(f"row.{tags}"), F.lit(0)), F.col(f"row.{question}"))
    made = F.concat(F.coalesce("fallback", F.lit("none")), F.lit(":topic:fallback:"), T.slug(label))
    pick = lambda name, other: F.when(F.col("stage") == "matched", F.col("first")[name]).when(F.col("stage") == "within", F.col("second")[name]).otherwise(other)
    return second.withColumn("stage", stage).select(
        "row.*", pick("node_id", made).alias("node_id"), pick("subject", F.col("fallback")).alias("subject"), pick("score", F.lit(0.0)).alias("score"), "stage"
    )


def matches(texts: DataFrame, labels: DataFrame, stop: list[str]) -> DataFrame:
    """(text, label, m) of all pairs of distinct normalised texts (``text``) and labels (``label``) whose ``text_match`` isn't 0.

    Such a pair shares a token, or one holds the other: candidates come from an equal join on tokens and from ``phrases.alias_hits`` either
    way, so neither side is multiplied by the other.
    """
    from .phrases import alias_hits

    words = lambda c: F.filter(F.split(c, " "), lambda x: (F.length(x) > 2) & ~x.isin(stop))
    a = texts.filter("text != ''").select("text").distinct().withColumn("_ta", words("text"))
    b = labels.filter("label != ''").select("label").distinct().withColumn("_tb", words("label"))
    token = lambda df, c, t: df.select(c, F.explode(F.array_distinct(t)).alias("token"))
    shared = token(a, "text", "_ta").join(token(b, "label", "_tb"), "token").select("text", "label")
    inside = alias_hits(a, b.select(F.col("label").alias("ord"), "label"), "text", "text", "label").select("text", F.col("ord").alias("label"))
    around = alias_hits(b, a.select(F.col("text").alias("ord"), "text"), "label", "label", "text").select(F.col("ord").alias("text"), "label")
    pairs = shared.unionByName(inside).unionByName(around).distinct().join(a, "text").join(b, "label")
    side = lambda n, t: F.struct(F.col(n).alias("n"), F.col(t).alias("t"))
    return pairs.select("text", "label", text_match(side("text", "_ta"), side("label", "_tb")).alias("m")).filter("m > 0")


def placed_by_candidates(
    rows: DataFrame, nodes: DataFrame, tags: str, question: str, subjects: str, hint: str, fallback: str, noise: list[str], stop: list[str],
    essay: str | None = None, prompts: DataFrame | None = None, theme: str = "General essay theme",
) -> DataFrame:
    """The rows of ``placed`` for a taxonomy of any size: nodes are found by joins, and only those that match a row's texts are scored for it.

    A node without a match scores HINT + PAPER at most, which is below LEAST_WITHIN, so none is missed. Texts and labels are matched once however
    many rows and nodes have them. With ``essay``, nodes of that subject are only found through ``prompts`` (prompt, node_id): a row whose
    fallback it is takes the node of its question's prompt (stage prompt), equal after ``question_normalise``, the least node id of several, else
    one made for ``theme``.
    """
    from .rounds import settled

    none = F.array().cast("array<string>")
    ready = settled(rows.select(
        F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"),
        F.transform(F.coalesce(F.col(tags), none), lambda x: label_normalise(x, noise)).alias("tags"), label_normalise(question, noise).alias("q"),
        F.coalesce(F.col(subjects), none).alias("pool"), F.col(hint).alias("hint"), F.col(fallback).alias("fallback"), T.question_normalise(question).alias("asked"),
    ))
    known = nodes if essay is None else nodes.filter(~F.col("subject").eqNullSafe(F.lit(essay)))
    known = settled(known.select("ord", "node_id", "subject", label_normalise("label", noise).alias("label"), label_normalise("paper", noise).alias("paper")))
    said = ready.select("rid", F.explode("tags").alias("text")).distinct()
    texts = said.select("text").union(ready.select(F.col("q").alias("text")))
    found = settled(matches(texts, known, stop))
    by_tag = said.join(found, "text").groupBy("rid", "label").agg(F.max("m").alias("tag")).withColumn("own", F.lit(0.0))
    by_question = ready.select("rid", F.col("q").alias("text")).join(found, "text").select("rid", "label", F.lit(0.0).alias("tag"), F.col("m").alias("own"))
    both = by_tag.unionByName(by_question).groupBy("rid", "label").agg(F.max("tag").alias("tag"), F.max("own").alias("own"))
    scored = both.join(known, "label").join(ready.select("rid", "q", "pool", "hint", "fallback"), "rid")
    paper = F.when(F.col("q").contains(F.col("paper")), PAPER).otherwise(0.0)

    def best(keep: Column, hinted: str, name: str) -> DataFrame:
        score = F.round(F.col("tag") * TAG + F.col("own") * QUESTION + F.when(F.col("subject") == F.col(hinted), HINT).otherwise(0.0) + paper, 9)
        one = F.struct(score.alias("score"), (-F.col("ord")).alias("o"), "node_id", "subject")
        return scored.filter(keep).groupBy("rid").agg(F.max(one).alias(name))

    first = best((F.size("pool") == 0) | F.array_contains("pool", F.col("subject")), "hint", "first")
    second = best(F.col("subject") == F.col("fallback"), "fallback", "second")
    out = ready.join(first, "rid", "left").join(second, "rid", "left")
    named = F.lit(None).cast("string")
    if essay is not None and prompts is not None:
        table = prompts.select(T.question_normalise("prompt").alias("asked"), "node_id").filter("asked != ''").groupBy("asked").agg(F.min("node_id").alias("prompt_node"))
        out, named = out.join(table, "asked", "left"), F.col("prompt_node")
    weak = F.col("first").isNull() | (F.col("first")["score"] < LEAST)
    is_essay = F.lit(False) if essay is None else F.col("fallback").eqNullSafe(F.lit(essay))
    stage = (
        F.when(~weak, "matched").when(is_essay & named.isNotNull(), "prompt").when(~is_essay & (F.col("second")["score"] >= LEAST_WITHIN), "within").otherwise("made")
    )
    label = F.when(is_essay, F.lit(theme)).otherwise(F.coalesce(F.get(F.col(f"row.{tags}"), F.lit(0)), F.col(f"row.{question}")))
    made = F.concat(F.coalesce("fallback", F.lit("none")), F.lit(":topic:fallback:"), T.slug(label))
    out = out.withColumn("stage", stage)
    pick = lambda name, other, prompt: F.when(F.col("stage") == "matched", F.col("first")[name]).when(F.col("stage") == "within", F.col("second")[name]).when(F.col("stage") == "prompt", prompt).otherwise(other)
    return out.select(
        "row.*", pick("node_id", made, named).alias("node_id"), pick("subject", F.col("fallback"), F.col("fallback")).alias("subject"),
        pick("score", F.lit(0.0), F.lit(1.0)).alias("score"), "stage",
    )
