"""Merging rows of one key, indexes of keywords and concepts, lookups with fallbacks, trees, pruning and staged matches.

Where a list of a group's members is made, its members are ranked and cut before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import first_per_key

GRAM = 3


def overlaid(base: DataFrame, curated: DataFrame, key: str, columns: list[str], missing: str | None = None) -> DataFrame:
    """``base`` with the curated value of each column where there is one; ``missing`` counts as none."""
    value = lambda c: F.nullif(F.col(f"_{c}"), F.lit(missing)) if missing is not None else F.col(f"_{c}")
    more = curated.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(more, key, "left")
    return joined.select(*[F.coalesce(value(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def public(rows: DataFrame, private: list[str], texts: dict[str, tuple[Column, str]]) -> DataFrame:
    """Without ``private`` columns; ``texts``: column to (when to hide it, what stands there instead)."""
    for c, (hide, fixed) in texts.items():
        rows = rows.withColumn(c, F.when(hide, fixed).otherwise(F.col(c)))
    return rows.drop(*private)


def shells(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Nested lists become their sizes."""
    return rows.select(*[c for c in rows.columns if c not in lists], *[F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in lists])


def merged_duplicates(rows: DataFrame, keys: list[str], text: str, quality: Column, order: str, fields: list[str]) -> DataFrame:
    """One row a key: the text of best quality (the earlier of equals), and each field as the rows that bettered all before them leave it: the last
    of theirs that is not null; n, and the first row's order."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    better = rows.withColumn("_q", quality).withColumn("_better", F.col("_q") > F.coalesce(F.max("_q").over(before), F.lit(-1)))
    ok = lambda c: F.when(F.col("_better") & F.col(c).isNotNull(), F.col(order))
    return better.groupBy(*keys).agg(*[F.max_by(c, ok(c)).alias(c) for c in (text, *fields)], F.count("*").alias("n"), F.min(order).alias("first"))


def listed_copies(rows: DataFrame, keys: list[str], ident: str, order: list, most: int) -> DataFrame:
    """(keys, n_copies, copies): distinct ``ident`` of each key, the first ``most`` in ``order``; of equal ones the first row counts."""
    one = first_per_key(rows, [*keys, ident], order)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, ident))
    ranked = one.select(*keys, ident, place.alias("r"))
    counts = ranked.groupBy(*keys).agg(F.count("*").alias("n_copies"))
    lists = ranked.filter(F.col("r") <= most).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", ident))), lambda x: x[ident]).alias("copies"))
    return counts.join(lists, keys)


def concatenated(rows: DataFrame, key: str, lists: list[str], order: str) -> DataFrame:
    """One row a key: its rows' lists one after the other."""
    return rows.groupBy(key).agg(*[_joined(c, order) for c in lists])


def _joined(c: str, order: str) -> Column:
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])).alias(c)


def keyword_index(rows: DataFrame, ident: str, words: str, most: int = 12) -> DataFrame:
    """(keyword, n, first): in how many rows a keyword is, and the ``most`` smallest ids."""
    each = rows.select(ident, F.explode(F.array_distinct(words)).alias("keyword"))
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(ident))
    first = each.withColumn("r", place).filter(F.col("r") <= most).groupBy("keyword").agg(F.array_sort(F.collect_list(ident)).alias("first"))
    return each.groupBy("keyword").agg(F.count("*").alias("n")).join(first, "keyword")


def concept_index(documents: DataFrame, chunks: DataFrame, ident: str, subject: str, concepts: str, most: int = 20) -> DataFrame:
    """(concept, documents, mentions, subjects): documents and chunks with the concept, and the first ``most`` subjects of its documents."""
    d = documents.select(ident, subject, F.explode(F.array_distinct(concepts)).alias("concept"))
    counts = d.groupBy("concept").agg(F.count_distinct(ident).alias("documents"))
    kinds = d.filter(F.col(subject).isNotNull()).select("concept", subject).distinct()
    place = F.row_number().over(Window.partitionBy("concept").orderBy(subject))
    kinds = kinds.withColumn("r", place).filter(F.col("r") <= most).groupBy("concept").agg(F.array_sort(F.collect_list(subject)).alias("subjects"))
    said = chunks.select(F.explode(F.array_distinct(concepts)).alias("concept")).groupBy("concept").agg(F.count("*").alias("mentions"))
    return counts.join(said, "concept", "left").join(kinds, "concept", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def themes(rows: DataFrame, theme: str, members: dict[str, str], kind: str) -> DataFrame:
    """(theme, distinct counts of members under their names, cross, n); cross: members of several kinds."""
    counts = [F.count_distinct(c).alias(n) for n, c in members.items()]
    return rows.groupBy(theme).agg(*counts, (F.count_distinct(kind) > 1).alias("cross"), F.count("*").alias("n"))


def people(rows: DataFrame, key: str, name: str, rank: str, year: str, ident: str, order: str, most: int = 12) -> DataFrame:
    """One row a matching key: aliases and ids (the first ``most`` of each), least rank, the first row's year, how many rows."""
    sums = rows.groupBy(key).agg(F.min(rank).alias("rank"), F.min_by(year, F.when(F.col(year).isNotNull(), F.col(order))).alias("year"), F.count("*").alias("n"))
    aliases = listed_copies(rows.select(key, name, order), [key], name, [order], most).select(key, F.col("copies").alias("aliases"))
    ids = listed_copies(rows.select(key, ident, order), [key], ident, [order], most).select(key, F.col("copies").alias("ids"))
    return sums.join(aliases, key).join(ids, key)


def progress(rows: DataFrame, keys: list[str], done: str, at: str, count: str, syncing: bool = False) -> DataFrame:
    """One row a key: done if any is, the latest time, and the sum of counts, their maximum while ``syncing``."""
    return rows.groupBy(*keys).agg(F.bool_or(done).alias(done), F.max(at).alias(at), (F.max if syncing else F.sum)(count).alias(count))


def merged_once(own: DataFrame, other: DataFrame, markers: DataFrame, user: str, keys: list[str], done: str, at: str, count: str) -> DataFrame:
    """Progress of ``own`` with that of ``other`` for users without a marker: a merge that was made is not made again."""
    fresh = other.join(markers.select(user).distinct(), user, "left_anti")
    return progress(own.unionByName(fresh), [user, *keys], done, at, count)


def alias_index(rows: DataFrame, alias: str, ident: str, order: str) -> DataFrame:
    """(alias, ident): of several the last by ``order``."""
    return rows.filter(F.col(alias).isNotNull()).groupBy(alias).agg(F.max_by(ident, order).alias(ident))


def percent_done(required: DataFrame, done: DataFrame, group: str, item: str, user: str) -> DataFrame:
    """(user, group, percent): share of a group's required items that a user has done, in whole percent, of users with any."""
    wanted = required.groupBy(group).agg(F.count_distinct(item).alias("wanted"))
    have = required.select(group, item).distinct().join(done.select(user, item).distinct(), item).groupBy(user, group).agg(F.count("*").alias("have"))
    return have.join(wanted, group).select(user, group, F.floor(100 * F.col("have") / F.col("wanted") + 0.5).cast("int").alias("percent"))


def section_index(rows: DataFrame, section: str, part: str) -> DataFrame:
    """(section, part, n): counts with totals; null stands for all."""
    return rows.rollup(section, part).agg(F.count("*").alias("n"), F.grouping(section).alias("g1"), F.grouping(part).alias("g2")).select(
        F.when(F.col("g1") == 0, F.coalesce(section, F.lit("none"))).alias(section), F.when(F.col("g2") == 0, F.coalesce(part, F.lit("none"))).alias(part), "n"
    )


def nested_size(entries: Column, field: str) -> Column:
    """Items in the ``field`` lists of all entries."""
    return F.aggregate(F.coalesce(entries, F.array()), F.lit(0), lambda a, x: a + F.greatest(F.coalesce(F.size(x[field]), F.lit(0)), F.lit(0)))


def lookup(rows: DataFrame, table: DataFrame, keys: list[Column], table_key: str, value: str, order: str) -> DataFrame:
    """``rows`` with ``value`` of the first key that hits, then of the first key that hits without regard to case; of several the least by ``order``."""
    exact = table.groupBy(F.col(table_key).alias("_k")).agg(F.min_by(value, order).alias("_v"))
    loose = table.groupBy(F.lower(table_key).alias("_k")).agg(F.min_by(value, order).alias("_v"))
    found = []
    for name, key, index in [*[(f"_e{i}", k, exact) for i, k in enumerate(keys)], *[(f"_l{i}", F.lower(k), loose) for i, k in enumerate(keys)]]:
        rows = rows.withColumn("_key", key).join(index.withColumnsRenamed({"_k": "_key", "_v": name}), "_key", "left").drop("_key")
        found.append(name)
    return rows.withColumn(value, F.coalesce(*found)).drop(*found)


def _heads(c: str) -> Column:
    return F.substring(c, 1, GRAM)


def _grams(c: str) -> Column:
    spots = F.sequence(F.lit(1), F.greatest(F.length(c) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(c, i, F.lit(GRAM))))


def containing(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) of which one holds the other; both have GRAM characters or more.

    The contained text's first GRAM characters are among the other's: an equal join, then the test.
    """
    x, y = (df.filter(F.length(c) >= GRAM).select(c).distinct() for df, c in ((left, a), (right, b)))
    within = x.select(a, F.explode(_grams(a)).alias("g")).join(y.select(b, _heads(b).alias("g")), "g").filter(F.col(a).contains(F.col(b)))
    around = y.select(b, F.explode(_grams(b)).alias("g")).join(x.select(a, _heads(a).alias("g")), "g").filter(F.col(b).contains(F.col(a)))
    return within.select(a, b).union(around.select(a, b)).distinct()


def contained_lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: str, unique: bool = False) -> DataFrame:
    """(key, value, stage): an equal key first, else one that holds the other; the least by ``order``, or, if ``unique``, only where there is just one."""
    equal = rows.select(key).distinct().join(table.select(F.col(table_key).alias(key), value, order), key)
    exact = equal.groupBy(key).agg(F.min_by(value, order).alias(value)).withColumn("stage", F.lit("exact"))
    rest = rows.select(key).distinct().join(exact.select(key), key, "left_anti")
    pairs = containing(rest, table, key, table_key).join(table.select(table_key, value, order), table_key)
    near = pairs.groupBy(key).agg(F.min_by(value, order).alias(value), F.count_distinct(table_key).alias("n"))
    near = near.filter("n = 1" if unique else "n >= 1").drop("n").withColumn("stage", F.lit("contained"))
    return exact.unionByName(near)


def expanded(accepted: DataFrame, answers: DataFrame, card: str, order: list, most: int) -> DataFrame:
    """The answers of accepted cards, ``most`` of each, in order."""
    rows = accepted.join(answers, card)
    place = F.row_number().over(Window.partitionBy(*accepted.columns).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def tree_counts(nodes: DataFrame, counts: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """(node, path, n): labels from the root, and own counts with those of all nodes below; trees of any depth, by ``rounds.tree_sums``."""
    from .rounds import tree_sums

    return tree_sums(nodes, counts, node, parent, label).select(node, F.array_join("path", " > ").alias("path"), "n")


def pruned(entries: DataFrame, status: DataFrame, group: str, link: str, good: str) -> DataFrame:
    """Entries with a link of good status; groups left empty are gone, and ``number`` counts the others anew, in their order."""
    from .grouping import dense_ids

    ok = status.filter(F.col(good)).select(link).distinct()
    kept = entries.filter(F.col(link).isNotNull()).join(ok, link, "left_semi")
    numbers = dense_ids(kept.select(group).distinct(), group, "number")
    return kept.join(numbers, group)


def published_links(rows: DataFrame, sources: DataFrame, ident: str, url: str, own: Column) -> DataFrame:
    """``rows`` with their link if it is our own, else that of their id, else null."""
    known = sources.groupBy(ident).agg(F.min(url).alias("_u"))
    return rows.join(known, ident, "left").withColumn(url, F.when(own, F.col(url)).otherwise(F.col("_u"))).drop("_u")


def leaks(rows: DataFrame, pattern: str) -> DataFrame:
    """(n): how often ``pattern`` is in the rows as JSON."""
    return rows.agg(F.coalesce(F.sum(F.regexp_count(F.to_json(F.struct("*")), F.lit(pattern))), F.lit(0)).alias("n"))


def tag_counts(rows: DataFrame, tags: str, most: int = 30) -> DataFrame:
    """(tag, n) of the most frequent tags, ties by tag."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


# ---- staged matches of prompts ----


def prompt_score(asked: Column, held: Column, theme: Column, other_theme: Column) -> Column:
    """struct(confidence, coverage, jaccard, theme, shared, floor) of distinct token arrays: 0.68 coverage, 0.22 Jaccard, 0.1 theme; 0.94 at most."""
    shared = F.size(F.array_intersect(asked, held))
    cover = shared / F.greatest(F.lit(1), F.size(asked))
    jaccard = shared / F.greatest(F.lit(1), F.size(F.array_union(asked, held)))
    both = F.size(F.array_intersect(theme, other_theme))
    near = F.when(both > 0, both / F.greatest(F.lit(1), F.least(F.greatest(F.size(theme), F.lit(1)), F.greatest(F.size(other_theme), F.lit(1))))).otherwise(0.0)
    confidence = F.least(F.lit(0.94), cover * 0.68 + jaccard * 0.22 + near * 0.1)
    return F.struct(confidence.alias("confidence"), cover.alias("coverage"), jaccard.alias("jaccard"), near.alias("theme"), shared.alias("shared"), F.greatest(cover, jaccard, near).alias("floor"))


def prompt_class(s: Column) -> Column:
    """strong, topic-match, loose-topic-match, or null."""
    return (
        F.when((s["shared"] >= 3) & (s["coverage"] >= 0.5), "strong").when((s["shared"] >= 2) & (s["coverage"] >= 0.24) & (s["confidence"] >= 0.22), "topic-match")
        .when((s["shared"] >= 1) & (s["theme"] >= 0.34) & (s["coverage"] >= 0.12) & (s["confidence"] >= 0.24), "loose-topic-match")
    )


def _equal_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (left_id, right_id) of equal keys, and the distinct ids of ``left`` that have one, which are found without the pairs.

    Rows are made distinct before the join. Only ids of ``left`` with several keys can meet a row twice, so no other pairs are compared.
    """
    left, right = left.distinct(), right.distinct()
    several = left.groupBy(left_id).agg(F.count("*").alias("_n")).filter("_n > 1").select(left_id)
    pairs = left.join(several, left_id, "left_anti").join(right, key).select(left_id, right_id)
    twice = left.join(several, left_id, "left_semi").join(right, key).select(left_id, right_id).distinct()
    return pairs.unionByName(twice), left.join(right.select(key).distinct(), key, "left_semi").select(left_id).distinct()


def staged_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, normal: str, toks: str, theme: str, most: int = 18) -> DataFrame:
    """(left_id, right_id, stage, confidence, type): equal texts; for rows without one, equal token signatures of two tokens or more; for the rest, scored pairs
    that share a token, one row a right id, ``most`` at most.

    Pairs are found by tokens; a token that more than one in ten right rows hold finds none, unless it is the row's rarest.
    """
    sign = lambda df: df.withColumn("_sig", F.array_join(F.sort_array(F.array_distinct(toks)), " "))
    left, right = sign(left), sign(right)
    texts = left.filter(F.col(normal) != "").select(left_id, normal)
    exact, met = _equal_pairs(texts, right.select(right_id, normal), left_id, right_id, normal)
    exact = exact.select(left_id, right_id, F.lit("exact").alias("stage"), F.lit(1.0).alias("confidence"), F.lit("direct").alias("type"))
    rest = left.join(met, left_id, "left_anti")
    signed = right.filter(F.size(F.array_distinct(toks)) >= 2).select(right_id, "_sig")
    same, met = _equal_pairs(rest.filter(F.col("_sig") != "").select(left_id, "_sig"), signed, left_id, right_id, "_sig")
    same = same.select(left_id, right_id, F.lit("signature").alias("stage"), F.lit(0.98).alias("confidence"), F.lit("direct").alias("type"))
    rest = rest.join(met, left_id, "left_anti")
    held = right.select(right_id, F.explode(F.array_distinct(toks)).alias("token"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    total = right.agg(F.count("*").alias("total"))
    asked = rest.select(left_id, F.explode(F.array_distinct(toks)).alias("token")).join(df, "token").join(F.broadcast(total))  # one row
    rare = F.row_number().over(Window.partitionBy(left_id).orderBy("df", "token"))
    asked = asked.withColumn("r", rare).filter((F.col("df") * 10 <= F.col("total")) | (F.col("r") == 1)).select(left_id, "token")
    pairs = asked.join(held, "token").select(left_id, right_id).distinct()
    a = rest.select(left_id, F.array_distinct(toks).alias("_a"), F.array_distinct(theme).alias("_ta"))
    b = right.select(right_id, F.array_distinct(toks).alias("_b"), F.array_distinct(theme).alias("_tb"))
    scored = pairs.join(a, left_id).join(b, right_id).withColumn("s", prompt_score(F.col("_a"), F.col("_b"), F.col("_ta"), F.col("_tb")))
    scored = scored.withColumn("type", prompt_class(F.col("s"))).filter("type is not null")
    value = F.greatest(F.col("s.confidence"), F.col("s.floor"))
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc(F.round(value + F.least(F.lit(0.12), F.col("s.shared") * 0.03), 9)), right_id))
    best = scored.withColumn("r", place).filter(F.col("r") <= most)
    return exact.union(same).union(best.select(left_id, right_id, F.lit("scored"), value, "type"))


#: Fixed value: semantic hits that count at most.
HITS = 8


def topic_tokens(toks: Column, noise: list[str]) -> Column:
    """Tokens without ``noise`` and numbers of one or two digits; repeats stay."""
    return F.filter(toks, lambda t: ~t.isin(noise) & ~t.rlike("^[0-9]{1,2}$"))


def boosted(confidence: Column, anchors: Column, hits: Column, subject: Column, overlap: Column) -> Column:
    """Pair confidence with 0.07 an anchor (0.18 at most), 0.025 a semantic hit (0.08), 0.04 for the subject, 0.14 times the topic overlap; 0.99 at most."""
    return F.least(
        F.lit(0.99), confidence + F.least(F.lit(0.18), anchors * 0.07) + F.least(F.lit(0.08), hits * 0.025) + F.when(subject, 0.04).otherwise(0.0) + F.least(F.lit(0.14), overlap * 0.14)
    )


def link_class(
    confidence: Column, shared: Column, cover: Column, heavy: Column, subject: Column, anchors: Column, hits: Column, overlap: Column, topic_hits: Column, floor: Column,
    high: float = 0.82, strong: float = 0.68, topic: float = 0.3, loose: float = 0.3,
) -> Column:
    """strong, topic-match, loose-topic-match or none, by the gates of each; thresholds are parameters."""
    return (
        F.when((confidence >= high) & (shared >= 5) & (cover >= 0.72) & (heavy >= 0.76), "strong")
        .when((confidence >= strong) & subject & (anchors >= 1) & (hits >= 1) & (heavy >= 0.36), "strong")
        .when(subject & (overlap >= topic) & ((shared >= 2) | (anchors >= 1) | (heavy >= 0.18)), "topic-match")
        .when(subject & (floor >= loose) & (topic_hits >= 1) & ((shared >= 1) | (hits >= 2)), "loose-topic-match").otherwise("none")
    )
