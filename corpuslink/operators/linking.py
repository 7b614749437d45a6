"""Linking one corpus to another: idf, exact and signature joins, rare-token candidates, pair scores, classes.

The candidate join explodes tokens on both sides. A left row asks by its rarest tokens only, and a token
too light is not asked by at all unless a row has nothing rarer, so a frequent token alone can't pair everything with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idf(rows: DataFrame, toks: str) -> DataFrame:
    """(token, df, weight): weight = ln((N + 1) / (df + 1)) + 1."""
    total = rows.agg(F.count("*").alias("total"))
    df = rows.select(F.explode(F.array_distinct(toks)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("token", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("weight"))  # one row


def exact_links(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Pairs with the same non-empty key."""
    return left.filter(F.col(on) != "").join(right.filter(F.col(on) != ""), on)


def asking(left: DataFrame, weights: DataFrame, left_id: str, toks: str, rare: int = 10, least: float = 1.65) -> DataFrame:
    """(left_id, token, weight, asked): the distinct tokens of each left row. Asked by are its ``rare`` rarest; past the first that
    hits anything, they must weigh ``least`` or more."""
    rows = left.select(left_id, F.explode(F.array_distinct(toks)).alias("token")).join(weights, "token")
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("weight"), "token"))
    return rows.withColumn("r", rank).select(left_id, "token", "weight", ((F.col("r") <= rare) & ((F.col("weight") >= least) | (F.col("r") == 1))).alias("asked"))


def linked(
    left: DataFrame, right: DataFrame, weights: DataFrame, left_id: str, right_id: str, toks: str, rare: int = 10, least: float = 1.65,
    left_keep: tuple[str, ...] = (), right_keep: tuple[str, ...] = (), extra: dict[str, Column] | None = None,
) -> DataFrame:
    """The candidates with shared, cover, mapped_cover, jaccard, idf_cover, idf_mapped and confidence.

    The tokens a left row asks by find its candidates; a token it doesn't ask by joins nothing. Tokens are numbered by their 64-bit hashes, so
    that pairs are joined, and sets intersected, as integers; the right rows' numbers meet their pairs once. ``right`` is read
    several times: store it where its tokens are dear. Kept are columns of either side; ``extra`` are Columns on these and on
    ``_r``, the right row's distinct numbers.
    """
    number = lambda t: F.xxhash64(t)
    lt = asking(left, weights, left_id, toks, rare, least).withColumn("_n", number("token"))
    held = right.select(right_id, *right_keep, F.array_distinct(F.transform(toks, number)).alias("_r"))
    each = held.select(right_id, F.explode("_r").alias("_n"))
    sums = lambda t, ident, name: t.groupBy(ident).agg(F.count("*").alias(f"n_{name}"), F.sum("weight").alias(f"w_{name}"))
    rs = sums(each.join(weights.select(number("token").alias("_n"), "weight"), "_n"), right_id, "right")
    ls = lt.groupBy(left_id).agg(
        F.count("*").alias("n_left"), F.sum("weight").alias("w_left"), F.sort_array(F.collect_list(F.struct("_n", "weight"))).alias("_l")  # one row's tokens
    )
    if left_keep:
        ls = ls.join(left.select(left_id, *left_keep), left_id)
    pairs = lt.filter("asked").select(left_id, "_n").join(each, "_n").select(left_id, right_id).distinct()
    rows = pairs.join(ls, left_id).join(held, right_id).withColumns({"_s": F.array_intersect(F.transform("_l", lambda x: x["_n"]), "_r"), **(extra or {})})
    kept = [*left_keep, *right_keep, *(extra or {})]
    rows = rows.select(
        left_id, right_id, *kept, "n_left", "w_left", F.size("_s").cast("long").alias("shared"),
        F.aggregate(F.filter("_l", lambda x: F.array_contains("_s", x["_n"])), F.lit(0.0), lambda a, x: a + x["weight"]).alias("w_shared"),
    ).join(rs, right_id)
    cover, mapped = F.col("shared") / F.col("n_left"), F.col("shared") / F.col("n_right")
    jaccard = F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))
    heavy, heavy_mapped = F.col("w_shared") / F.col("w_left"), F.col("w_shared") / F.col("w_right")
    confidence = F.least(F.lit(0.99), 0.24 * cover + 0.18 * mapped + 0.15 * jaccard + 0.24 * heavy + 0.09 * heavy_mapped)
    return rows.select(
        left_id, right_id, *kept, "shared", cover.alias("cover"), mapped.alias("mapped_cover"), jaccard.alias("jaccard"),
        heavy.alias("idf_cover"), heavy_mapped.alias("idf_mapped"), confidence.alias("confidence"),
    )


def classed(score: Column, strong: float = 0.72, topic: float = 0.3) -> Column:
    return F.when(score >= strong, "strong").when(score >= topic, "topic-match").otherwise("none")


def vocabulary_join(terms: DataFrame, vocabulary: DataFrame, term: str, token: str) -> DataFrame:
    """Fuzzy pairs of terms and vocabulary tokens: equal, contained, or within one edit (two if longer than five).

    Edits: a term and a token within k edits share a piece of the term left after deleting; both sides are joined on their
    deletion variants, so the join is on equal keys. Tokens longer than any term by more than two characters have none. Containment: the first four
    characters of the contained one are among the other's 4-grams; only the containing side has all of its grams.
    """
    from ..functions.text import fuzzy_match

    def pieces(c: str) -> Column:
        n = F.length(c)
        return F.array_distinct(F.flatten(F.array(F.array(F.col(c)), _deletions(F.col(c)), F.flatten(F.transform(F.when(n > 5, _deletions(F.col(c))).otherwise(F.array().cast("array<string>")), _deletions)))))

    longest = terms.agg(F.max(F.length(term))).first()[0] or 0
    a = terms.select(term, F.explode(pieces(term)).alias("piece"))
    b = vocabulary.filter(F.length(token) <= longest + 2).select(token, F.explode(pieces(token)).alias("piece"))
    near = a.join(b, "piece").select(term, token).distinct()
    grams = lambda df, c: df.select(c, F.explode(_grams(F.col(c))).alias("gram"))
    heads = lambda df, c: df.filter(F.length(c) >= 4).select(c, F.substring(c, 1, 4).alias("gram"))
    inside = grams(terms, term).join(heads(vocabulary, token), "gram").filter(F.col(term).contains(F.col(token))).select(term, token)
    around = heads(terms, term).join(grams(vocabulary, token), "gram").filter(F.col(token).contains(F.col(term))).select(term, token)
    inside = inside.union(around)
    return near.union(inside).distinct().filter(fuzzy_match(F.col(term), F.col(token)))


def _deletions(c: Column) -> Column:
    spots = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.transform(spots, lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def _grams(c: Column, size: int = 4) -> Column:
    spots = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(c, i, F.lit(size))))


def anchor_phrases(rows: DataFrame, weights: DataFrame, ident: str, toks: str, noise: list[str], sizes: tuple[int, ...] = (3, 2)) -> DataFrame:
    """(ident, phrase, ord): phrases of neighbouring tokens that are specific and weighty, once each, in order of size and place.

    Specific: a token of two to four digits, or one outside ``noise`` that has five characters or weighs 2.4. Weighty: 2.2 on average, or
    a token of eight characters. A token without a weight weighs 1.
    """
    places = rows.select(ident, F.posexplode(toks).alias("i", "token")).join(weights, "token", "left")
    one = F.struct("i", "token", F.coalesce("weight", F.lit(1.0)).alias("w"))
    lists = places.groupBy(ident).agg(F.sort_array(F.collect_list(one)).alias("t"))
    grams = []
    for k, n in enumerate(sizes):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: i + (n - 1) <= F.size("t"))
        grams.append(F.transform(starts, lambda i: F.struct((i + k * 10_000_000).alias("ord"), F.slice("t", i, F.lit(n)).alias("g"))))
    each = lists.select(ident, F.explode(F.concat(*grams)).alias("x")).select(ident, "x.ord", "x.g")
    digits = lambda x: x["token"].rlike("^[0-9]{2,4}$")
    specific = F.exists("g", lambda x: digits(x) | (~x["token"].isin(noise) & ((F.length(x["token"]) >= 5) | (x["w"] >= 2.4))))
    mean = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["w"]) / F.size("g")
    weighty = (mean >= 2.2) | F.exists("g", lambda x: F.length(x["token"]) >= 8)
    phrase = F.array_join(F.transform("g", lambda x: x["token"]), " ")
    return each.filter(specific & weighty).groupBy(ident, phrase.alias("phrase")).agg(F.min("ord").alias("ord"))


def strong_anchors(left: DataFrame, right: DataFrame, weights: DataFrame, left_id: str, right_id: str, toks: str, noise: list[str], most: int = 8) -> DataFrame:
    """(left_id, right_id, anchors): the first ``most`` anchor phrases of the left row that the right row holds; pairs without one are left out.

    The right rows' distinct phrases are joined on equality, so no text is searched for each pair.
    """
    asked = anchor_phrases(left, weights, left_id, toks, noise)
    spots = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), lambda i: i + (n - 1) <= F.size(toks))
    grams = [F.transform(spots(n), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " ")) for n in (2, 3)]
    held = right.select(right_id, F.explode(F.array_distinct(F.concat(*grams))).alias("phrase"))
    both = held.join(asked, "phrase").groupBy(left_id, right_id).agg(F.sort_array(F.collect_list(F.struct("ord", "phrase"))).alias("p"))
    return both.select(left_id, right_id, F.slice(F.transform("p", lambda x: x["phrase"]), 1, most).alias("anchors"))
