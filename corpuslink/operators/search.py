"""Ranked search: filters, score models, BM25, vectors, facets, pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine_score(terms: list[str], hay: Column, toks: Column, authority: Column) -> Column:
    """0.44 recall + 0.16 phrase + 0.22 Jaccard + authority."""
    want = F.lit(terms)
    both = F.size(F.filter(want, lambda t: F.array_contains(toks, t)))
    recall = both / F.lit(len(terms))
    jaccard = F.size(F.array_intersect(want, toks)) / F.greatest(F.size(F.array_union(want, toks)), F.lit(1))
    return 0.44 * recall + F.when(hay.contains(" ".join(terms)), 0.16).otherwise(0.0) + 0.22 * jaccard + authority


def bm25(rows: DataFrame, ident: str, toks: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that hold a term. Only postings of the asked terms are made; lengths and frequencies are aggregates."""
    sized = rows.select(ident, F.size(toks).alias("len"), F.filter(toks, lambda t: t.isin(terms)).alias("hit"))
    stats = sized.agg(F.count("*").alias("total"), F.avg("len").alias("avg_len"))
    postings = sized.filter(F.size("hit") > 0).select(ident, "len", F.explode("hit").alias("term")).groupBy(ident, "len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row a term, and one row
    weight = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return scored.groupBy(ident).agg(F.sum(part).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)


def page(rows: DataFrame, order: list, offset: int, limit: int, most: int = 60) -> DataFrame:
    """Rows offset .. offset + limit of a total order; the limit is kept between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def facets(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(facet, value, n): the most frequent values of each column, ties by value."""
    out = None
    for name, k in columns.items():
        one = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
        one = one.orderBy(F.desc("n"), "value").limit(k).select(F.lit(name).alias("facet"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def bm25_queries(rows: DataFrame, queries: DataFrame, ident: str, query: str, toks: str, terms: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score): BM25 of every query of a table against all rows; ``terms`` and ``toks`` are arrays.

    Tokens are exploded once; postings of unasked terms end at the join with the distinct terms.
    """
    sized = rows.select(ident, F.size(toks).alias("len"), F.explode(toks).alias("term"))
    stats = rows.agg(F.count("*").alias("total"), F.avg(F.size(toks)).alias("avg_len"))
    asked = queries.select(query, F.explode(F.array_distinct(terms)).alias("term"))
    tf = sized.join(asked.select("term").distinct(), "term", "left_semi").groupBy(ident, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(stats))  # one row
    weight = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return scored.select(ident, "term", part.alias("part")).join(asked, "term").groupBy(query, ident).agg(F.sum("part").alias("score"))


#: Scores made at once, and how far a product of matrices may be from the sum in order.
AT_ONCE, MARGIN = 4_000_000, 1e-9
#: Where fewer pairs than this share are met, no product of matrices is made.
FEW = 0.05


def _vectors(values: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: which rows have it, their vectors, a row a component, and their norms, summed in the components' order."""
    sizes, out = values.str.len().to_numpy(), {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        v = np.ascontiguousarray(np.array([np.asarray(x, "float64") for x in values.iloc[at]]).reshape(len(at), n).T)
        square = np.zeros(len(at))
        for x in v:
            square += x * x
        out[n] = (at, v, np.sqrt(square))
    return out


def _scaled(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.divide(v, norm, out=np.zeros_like(v), where=(norm > 0) & np.isfinite(norm))


def _first_of_block(k: int):
    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"q": asked["q"].iloc[:0], "id": held["id"].iloc[:0], "score": np.empty(0)})]
        if len(held) and len(asked):
            with np.errstate(all="ignore"):
                parts.extend(firsts(held, asked, k))
        return pd.concat(parts)

    return best


def firsts(held: pd.DataFrame, asked: pd.DataFrame, k: int, met=None, digits: int | None = None) -> Iterator[pd.DataFrame]:
    """(q, id, score) of the first k rows (id, v) of each query (q, v), itself left out; ties to the smaller id.

    ``met``: of numbers of queries, which rows each may find, as a matrix; all, if None. ``digits``: scores that are equal to so many places are ties.
    """
    ids, rank = np.unique(held["id"].to_numpy(), return_inverse=True)
    known = _vectors(held["v"])
    names = asked["q"].to_numpy()
    of = np.searchsorted(ids, names)
    own = np.where(ids[np.minimum(of, len(ids) - 1)] == names, of, -1)
    step = max(1, AT_ONCE // len(held))
    for size, (which, qv, qn) in _vectors(asked["v"]).items():
        at, v, norm = known.get(size, (np.empty(0, int), np.empty((size, 0)), np.empty(0)))
        unit, place = _scaled(v, norm), np.full(len(held), -1)
        place[at] = np.arange(len(at))
        for i in range(0, len(which), step):
            some, sv, sn = which[i : i + step], qv[:, i : i + step], qn[i : i + step]
            may = met(some) if met is not None else None
            if may is not None and may.mean() < FEW:
                near = np.where(may, np.inf, -np.inf)  # too few for a product: each is summed
            else:
                near = np.zeros((len(some), len(held)))  # of other lengths: 0
                near[:, at] = _scaled(sv, sn).T @ unit
                near[:, at[~np.isfinite(norm)]] = np.inf  # what a product can't tell is summed
                near[np.ix_(~np.isfinite(sn), at)] = np.inf
                if may is not None:
                    near[~may] = -np.inf
            near[rank[None, :] == own[some][:, None]] = -np.inf
            floor = np.partition(near, len(held) - k, axis=1)[:, len(held) - k] if len(held) > k else np.full(len(some), -np.inf)
            qi, ri = np.nonzero((near >= floor[:, None] - MARGIN) & (near != -np.inf))
            p = place[ri]
            dot, there = np.zeros(len(qi)), p >= 0
            a, b = p[there], qi[there]
            total = np.zeros(len(a))
            for x, y in zip(v, sv):
                total += x[a] * y[b]
            scale = norm[a] * sn[b]
            dot[there] = np.where(scale <= 0, 0.0, total / scale)
            key = np.where(np.isnan(dot), np.inf, dot if digits is None else np.round(dot, digits))  # Spark's order puts NaN above all
            order = np.lexsort((rank[ri], -key, ~np.isnan(dot), qi))
            qi, ri, dot = qi[order], ri[order], dot[order]
            first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            yield pd.DataFrame({"q": names[some[qi[first]]], "id": held["id"].to_numpy()[ri[first]], "score": dot[first]})


def vector_hits(rows: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, k: int, block: int = 16_384, asked: int = 8_192) -> DataFrame:
    """(query, id, score): of every query row the k rows of greatest cosine but itself, ties to the smaller id; null vectors take no part.

    Every pair is met: blocks of about ``block`` rows meet blocks of about ``asked`` queries in a task each. There, a product of matrices tells which rows come
    near the first k; their cosines are summed in the components' order, as ``cosine`` does, so that equal vectors have equal scores. k rows of a block leave the task.
    """
    clean = lambda df, c, name: df.filter(F.col(vector).isNotNull()).select(
        F.col(c).alias(name), F.when(F.exists(vector, lambda x: x.isNull()), F.array().cast(df.schema[vector].dataType)).otherwise(F.col(vector)).alias("v")
    )  # a null component makes every cosine 0, as an empty vector does
    held, want = clean(rows, ident, "id"), clean(queries, query, "q")
    n, m = (max(1, -(-df.count() // size)) for df, size in ((held, block), (want, asked)))  # two numbers
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    held = held.withColumn("a", part("id", n)).withColumn("b", each(m))
    want = want.withColumn("b", part("q", m)).withColumn("a", each(n))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = held.groupBy("a", "b").cogroup(want.groupBy("a", "b")).applyInPandas(_first_of_block(k), f"q {kind(want, 'q')}, id {kind(held, 'id')}, score double")
    found = found.select(F.col("q").alias(query), F.col("id").alias(ident), F.coalesce("score", F.lit(float("nan"))).alias("score"))  # pandas has no NaN beside null
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), ident))
    return found.withColumn("r", place).filter(F.col("r") <= k).drop("r")


def hybrid_queries(lexical: DataFrame, semantic: DataFrame, query: str, ident: str, weight: float = 0.5) -> DataFrame:
    """(query, id, lex, sem, score) of candidates (query, id, score) of both kinds: the best score of each kind, and their weighted sum."""
    zero = F.lit(0.0)
    one = lambda df, lex, sem: df.select(query, ident, lex.alias("lex"), sem.alias("sem"))
    both = one(lexical, F.col("score"), zero).unionByName(one(semantic, zero, F.col("score")))
    best = both.groupBy(query, ident).agg(F.max("lex").alias("lex"), F.max("sem").alias("sem"))
    return best.withColumn("score", weight * F.col("lex") + (1 - weight) * F.col("sem"))


def page_with_total(rows: DataFrame, order: list, offset: int, limit: int, most: int = 60) -> DataFrame:
    """As ``page``, with the total and the next cursor (null on the last page)."""
    total = rows.count()
    after = max(0, offset) + max(1, min(most, limit))
    return page(rows, order, offset, limit, most).withColumn("total", F.lit(total)).withColumn("next", F.lit(after if after < total else None).cast("long"))
