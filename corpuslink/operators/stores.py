"""Jobs that build what searches read: tagged rows with their index, a workspace over a taxonomy, a search store, and links pruned by their health.

Each takes tables and returns tables; what is read more than once is stored. Lists in results are cut where they say so, and counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.bucketed import refreshed_set
from ..streaming.counters import unseen
from .grouping import first_per_key
from .merging import keyword_index, listed_copies, merged_duplicates, pruned
from .phrases import alias_tags
from .placement import placed_by_candidates
from .rounds import settled, tree_sums


def tagged_and_indexed(
    rows: DataFrame, aliases: DataFrame, ident: str, text: str, category: str, defaults: dict[str, list[str]], most: int = 8, ids: int = 12
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tags``, and the index of tags (keyword, n, first ids).

    ``aliases`` (ord, alias, tag): a tag of every alias that the text contains, by ``ord``; then the category's ``defaults``; distinct, ``most`` at most.
    """
    found = alias_tags(rows, aliases.select("ord", "alias", "tag"), ident, text, "alias", "tag", ["ord"], most).drop("n")
    extra = F.array().cast("array<string>")
    for name, tags in defaults.items():
        extra = F.when(F.col(category) == name, F.array(*map(F.lit, tags))).otherwise(extra)
    none = F.array().cast("array<string>")
    found = settled(found)  # without the texts
    tagged = rows.join(found, ident, "left").withColumn("tags", F.slice(F.array_distinct(F.concat(F.coalesce("tags", none), extra)), 1, most))
    return tagged, keyword_index(tagged.select(ident, "tags"), ident, "tags", ids)


def workspace(
    cards: DataFrame, nodes: DataFrame, quality: Column, order: str, noise: list[str], stop: list[str], essay: str | None = None, prompts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Questions merged in their places, and the nodes with how many questions stand in them and below.

    ``cards``: question, tags, subjects, hint, fallback and ``order`` (unique); ``nodes``: ord, node_id, subject, label, paper, parent. A card is placed, cards of one node with one
    normalised question are one: the text of best ``quality``, how many cards, the first's order. Nodes made for cards come below a group of their
    subject's (subject:group:fallback); every node has ``own`` and ``n`` (own and below), whatever the depth.
    """
    placed = settled(placed_by_candidates(cards, nodes, "tags", "question", "subjects", "hint", "fallback", noise, stop, essay, prompts))
    keyed = placed.withColumn("key", T.question_normalise("question")).filter("key != ''")
    questions = settled(merged_duplicates(keyed, ["node_id", "key"], "question", quality, order, ["subject", "stage"]))
    group = F.concat(F.coalesce("subject", F.lit("none")), F.lit(":group:fallback"))
    made = placed.filter("stage = 'made'").select("node_id", group.alias("parent"), F.col("node_id").alias("label"), "subject").distinct()
    groups = made.select(F.col("parent").alias("node_id"), F.lit(None).cast("string").alias("parent"), F.coalesce("subject", F.lit("none")).alias("label")).distinct()
    every = nodes.select("node_id", F.col("parent").cast("string"), "label").unionByName(made.drop("subject")).unionByName(groups)
    own = questions.groupBy("node_id").agg(F.count("*").alias("own"))
    sums = tree_sums(every, own, "node_id", "parent", "label", "own")
    return questions, sums.join(own, "node_id", "left").select("node_id", F.array_join("path", " > ").alias("path"), F.coalesce("own", F.lit(0)).alias("own"), "n")


def pruned_links(entries: DataFrame, known: DataFrame, checked: DataFrame, group: str, link: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with a good link, renumbered by group; one row of counts; and the links that neither ``known`` nor ``checked`` (link, ok) has seen.

    Links are trimmed, empty ones are none. A link is good if the newer status, that of ``checked``, says so, else the older one; a link
    without a status is not good, so that an entry comes back once its link is checked. Several statuses of a link in one table: good if any is.
    """
    clean = entries.withColumn(link, F.nullif(F.trim(T.text(link)), F.lit("")))
    one = lambda df, rank: df.groupBy(link).agg(F.max("ok").alias("ok")).withColumn("_new", F.lit(rank))
    status = first_per_key(one(known, 0).unionByName(one(checked, 1)), [link], [F.desc("_new")]).select(link, "ok")
    rows = settled(clean.join(status.withColumnRenamed("ok", "_ok"), link, "left"))
    kept = pruned(rows.drop("_ok"), status, group, link, "ok")
    count = lambda cond: F.count(F.when(cond, 1))
    good = F.coalesce("_ok", F.lit(False))
    report = rows.agg(
        F.count("*").alias("entries"), count(F.col(link).isNull()).alias("without_link"), count(F.col(link).isNotNull() & ~good).alias("failing"), count(good).alias("kept"),
        F.count_distinct(group).alias("groups"), F.count_distinct(F.when(good, F.col(group))).alias("groups_kept"),
    )
    return kept, report, unseen(rows.filter(F.col(link).isNotNull()), status, link)


def search_store(
    questions: DataFrame, answers: DataFrame, quality: Column, path: str, version: str, ids: int = 12
) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of a search store, written as one version with checked keys and links; what was written, and in which order.

    ``questions``: question_id, question, subject, tags; ``answers``: answer_id, question_id, person, score. Answers of no question are left out. Tables:
    questions (with answers counted and the ``ids`` best), answers, subjects, tags, terms (question terms and tags with their questions), duplicates
    (questions of one key behind the one of best ``quality``) and a manifest of counts.
    """
    q = settled(first_per_key(questions, ["question_id"], ["question"]))
    a = settled(first_per_key(answers.join(q.select("question_id"), "question_id", "left_semi"), ["answer_id"], [F.desc("score"), "question_id"]))
    copies = listed_copies(a, ["question_id"], "answer_id", [F.desc("score")], ids)
    carded = settled(q.join(copies, "question_id", "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(0))))
    totals = [F.count("*").alias("questions"), F.sum("n_copies").alias("answers")]
    subjects = carded.groupBy("subject").agg(*totals)
    each = carded.select("question_id", "n_copies", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null")
    tags = each.groupBy("tag").agg(*totals)
    words = F.concat(F.filter(T.tokens(T.search_normalise("question")), lambda x: F.length(x) >= 3), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(x)))
    terms = keyword_index(q.select("question_id", words.alias("words")), "question_id", "words", ids)
    keyed = q.select("question_id", T.question_normalise("question").alias("key"), quality.alias("quality")).filter("key != ''")
    best = keyed.groupBy("key").agg(F.min_by("question_id", F.struct(-F.col("quality"), "question_id")).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    duplicates = keyed.join(best, "key").filter("question_id != keeper").select("question_id", "keeper")
    made = {"questions": carded, "answers": a, "subjects": subjects, "tags": tags, "terms": terms, "duplicates": duplicates}
    counts = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    made["manifest"] = counts
    keys = {"questions": ["question_id"], "answers": ["answer_id"], "tags": ["tag"], "terms": ["keyword"], "duplicates": ["question_id"], "manifest": ["name"]}
    links = [("answers", "question_id", "questions", "question_id"), ("duplicates", "question_id", "questions", "question_id"), ("duplicates", "keeper", "questions", "question_id")]
    order = refreshed_set(made, path, version, keys, links)
    spark = questions.sparkSession
    return {name: spark.read.parquet(f"{path}/{version}/{name}") for name in order}, order


#: What a path may not hold: escaped nulls and slashes, backslashes.
UNSAFE = ("%00", "%2f", "%5c", "\\")


def link_violations(rows: DataFrame, key: str, url: str, page: str, hosts: list[str], form: str, ending: str = ".pdf", stated: int | None = None) -> DataFrame:
    """(key, rule): every rule that a row breaks, a row for each; an empty result is a clean table.

    Rules: ``key`` (not of the ``form``, a pattern), ``scheme`` (not https), ``credentials``, ``query`` (or a fragment), ``host`` (none of ``hosts``), ``path`` (without the
    ``ending``, or unsafe) and ``page`` (given, and no number from 1). A row without a link breaks the key's rule at most. ``count``, without a key: the table has not
    as many rows as ``stated``.
    """
    u = F.trim(T.text(url))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://)?", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    named = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.lower(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    unsafe = F.lit(False)
    for x in UNSAFE:
        unsafe = unsafe | path.contains(x)
    number = F.col(page).cast("string").try_cast("double")
    there = u != ""
    broken = {
        "key": ~T.text(F.col(key).cast("string")).rlike(form), "scheme": there & ~F.lower(u).startswith("https://"), "credentials": there & authority.contains("@"),
        "query": there & u.rlike("[?#]"), "host": there & ~named.isin(hosts), "path": there & (~path.endswith(ending) | unsafe),
        "page": there & F.col(page).isNotNull() & F.coalesce(number.isNull() | (number < 1) | F.isnan(number), F.lit(True)),
    }
    rules = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in broken.items()]))
    found = rows.select(F.col(key), F.explode(rules).alias("rule"))
    if stated is None:
        return found
    whole = rows.agg(F.count("*").alias("n")).filter(F.col("n") != stated).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("count").alias("rule"))
    return found.unionByName(whole)
