"""Positional index and cover-density rank: all terms of a query must match, and the closer together they stand, the better.

The index has a row per (term, id) with the term's positions in that row, so it is built by one shuffle and can be stored and read again for any
number of query tables. A query first asks by its rarest term alone; only the rows found there are looked up for its other terms,
so a frequent term never pairs its query with all its rows. What is ranked is one row's positions of one query's terms.

Defined results: null texts have no tokens; a query without terms matches nothing; a query's repeated terms count once; a term that no
row holds leaves its query without matches; repeated ids are one row with the union of their positions.

``cover_density_best`` gives the first rows of every query only. Rows are dealt in blocks, distinct sets of terms meet each block in one task, and no more
than the first rows of a block leave it, so that pairs of queries and rows are neither shuffled nor stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grouping import top_per_group
from .rounds import settled

#: Fixed value: what one matched position is worth.
WORTH = 0.1


def positioned_tokens(c: Column | str, stop: list[str]) -> Column:
    """Array of (pos, token): stemmed tokens of ``link_tokens`` with their places among all tokens, from 1."""
    every = F.transform(T.tokens(T.question_normalise(c)), lambda t, i: F.struct((i + 1).cast("int").alias("pos"), T.stem(t).alias("token")))
    held = lambda t: ((F.length(t) >= 3) | t.rlike("^[0-9]{2,4}$")) & ~t.isin(stop)
    return F.filter(every, lambda x: held(x["token"]))


def positional_index(rows: DataFrame, ident: str, positions: str) -> DataFrame:
    """(term, ident, at): rising positions of each term in each row, from an array of (pos, token)."""
    each = rows.select(ident, F.explode(positions).alias("x")).select(F.col("x.token").alias("term"), ident, "x.pos")
    return each.groupBy("term", ident).agg(F.sort_array(F.collect_set("pos")).alias("at"))  # one row's positions of one term


def conjunctions(index: DataFrame, queries: DataFrame, ident: str, query: str, terms: str) -> DataFrame:
    """(query, ident, hits, m): rows that hold all ``m`` terms of a query; hits: rising array of (pos, k), k the term's number."""
    asked = queries.select(query, F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != ""))).alias("_t")).filter(F.size("_t") > 0)
    asked = asked.select(query, F.size("_t").alias("m"), F.posexplode("_t").alias("k", "term"))
    held = settled(index.join(asked.select("term").distinct(), "term", "left_semi"))  # read three times
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(df, "term")
    # Only queries all of whose terms are held somewhere go on; the rarest term asks.
    rarest = known.groupBy(query, "m").agg(F.count("*").alias("n"), F.min(F.struct("df", "term"))["term"].alias("term")).filter("n = m")
    found = rarest.select(query, "term").join(held.select("term", ident), "term").select(query, ident)
    pairs = found.join(asked, query).join(held, ["term", ident])
    hits = F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("k").alias("k")))))
    whole = pairs.groupBy(query, ident, "m").agg(F.count("*").alias("n"), F.sort_array(hits).alias("hits"))  # one row's positions of one query
    return whole.filter("n = m").select(query, ident, "hits", "m")


def cover_density(hits: Column, m: Column) -> Column:
    """Sum over the minimal stretches that hold all ``m`` terms: WORTH by one and the number of other positions inside.

    The hits pass by in order with each term's latest place; the earliest of these begins the stretch that ends here. Where that
    beginning has moved on since the hit before, the stretch is minimal.
    """
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("i"))
    start = F.struct(F.array_repeat(nowhere, m).alias("last"), F.lit(-1).alias("from"), F.lit(0).alias("i"), F.lit(0.0).cast("double").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["pos"].alias("pos"), s["i"].alias("i"))
        moved = F.transform(s["last"], lambda p, k: F.when(k == x["k"], here).otherwise(p))

        def after(last: Column, begin: Column) -> Column:
            others = (x["pos"] - begin["pos"]) - (s["i"] - begin["i"])
            new = (begin["pos"] >= 0) & (begin["pos"] > s["from"])
            return F.struct(
                last.alias("last"), F.when(new, begin["pos"]).otherwise(s["from"]).alias("from"), (s["i"] + 1).alias("i"),
                (s["sum"] + F.when(new, F.lit(WORTH) / (1 + others)).otherwise(0.0)).alias("sum"),
            )

        return T.once(moved, lambda last: T.once(F.array_min(last), lambda begin: after(last, begin)))

    return F.aggregate(hits, start, step, lambda s: s["sum"])


def cover_density_hits(index: DataFrame, queries: DataFrame, ident: str, query: str, terms: str) -> DataFrame:
    """(query, ident, score) of all rows that hold all terms of a query."""
    return conjunctions(index, queries, ident, query, terms).select(query, ident, cover_density(F.col("hits"), F.col("m")).alias("score"))


def places(rows: DataFrame, ident: str, positions: str, *more: str) -> DataFrame:
    """(ident, term, pos) and columns ``more``, a row a token, from an array of (pos, token)."""
    return rows.select(ident, *more, F.explode(positions).alias("_x")).select(ident, *more, F.col("_x.token").alias("term"), F.col("_x.pos").alias("pos"))


def block_covers(hits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that all terms hit, and their cover densities. ``hits``: of each term the rows and positions, in rising order.

    As ``cover_density``: hits pass by in order; the earliest of the terms' latest places begins the stretch that ends here, which is minimal where it has moved on.
    """
    rows = np.unique(hits[0][0])
    for r, _ in hits[1:]:
        rows = rows[np.isin(rows, r, assume_unique=False)]
        if not len(rows):
            return rows, np.empty(0)
    keys = []
    for k, (r, pos) in enumerate(hits):
        at = np.searchsorted(rows, r)
        kept = rows[np.minimum(at, len(rows) - 1)] == r
        keys.append((at[kept].astype(np.int64) << 44) | (pos[kept].astype(np.int64) << 12) | k)
    key = np.sort(np.concatenate(keys)) if len(keys) > 1 else keys[0]
    row, pos, term, n = key >> 44, (key >> 12) & 0xFFFFFFFF, key & 0xFFF, np.arange(len(key))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    begin = n
    for k in range(len(hits)):
        begin = np.minimum(begin, np.maximum.accumulate(np.where(term == k, n, -1)))
    whole = begin >= starts[row]  # every row of ``rows`` has hits, so that row numbers are dense
    moved = np.r_[True, pos[begin[1:]] > pos[begin[:-1]]] | np.r_[True, ~whole[:-1]] | np.r_[True, row[1:] != row[:-1]]
    ends = np.flatnonzero(whole & moved)
    b = begin[ends]
    worth = WORTH / (1 + np.maximum(0, (pos[ends] - pos[b]) - (ends - b)))  # rows of one id may hold two tokens at a place
    return rows, np.bincount(row[ends], worth, len(rows))


def _best_of_block(ident: str, most: int, ahead: str | None):
    def best(held: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(held[ident].to_numpy(), return_inverse=True)
        code, pos = held["code"].to_numpy(), held["pos"].to_numpy()
        tie = np.zeros(len(ids))
        if ahead:
            tie[row] = held[ahead].to_numpy()
        order = np.lexsort((pos, row, code))
        code, row, pos = code[order], row[order], pos[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])] if len(code) else np.empty(0, bool)
        code, row, pos = code[new], row[new], pos[new]
        names, first = np.unique(code, return_index=True)
        where = {c: slice(a, b) for c, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(code)])}
        out = []
        for key, codes in zip(sets["set"].tolist(), sets["codes"].tolist()):
            spans = [where.get(int(c)) for c in codes]
            if None in spans:
                continue
            spans.sort(key=lambda x: x.stop - x.start)
            found, score = block_covers([(row[x], pos[x]) for x in spans])
            if not len(found):
                continue
            rounded = np.round(score, 9)
            if len(found) > most:
                kept = rounded >= np.partition(rounded, -most)[-most]
                found, score, rounded = found[kept], score[kept], rounded[kept]
            top = np.lexsort((found, -tie[found], -rounded))[:most]  # ids are in their order
            out.append(pd.DataFrame({"set": np.full(len(top), key), ident: ids[found[top]], "score": score[top], "_tie": tie[found[top]]}))
        return pd.concat(out) if out else pd.DataFrame({"set": [], ident: ids[:0], "score": [], "_tie": []})

    return best


def cover_density_best(held: DataFrame, queries: DataFrame, ident: str, query: str, terms: str, most: int, blocks: int, ahead: str | None = None) -> DataFrame:
    """(query, ident, score): of every query the ``most`` rows of greatest cover density to 9 places, ties to the greater ``ahead`` (a number), then to the smaller id.

    ``held``: (ident, term, pos) and ``ahead``, as ``places`` makes them. Only places of asked terms are shuffled, once, to one of ``blocks`` tasks; a block should have
    some million of them at most. Terms asked for, and distinct sets of them, are small beside the rows: they go to every task.
    """
    asked = queries.select(query, F.explode(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != "")))).alias("term"))
    codes = settled(asked.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))
    of_query = settled(asked.join(codes, "term").groupBy(query).agg(F.sort_array(F.collect_set("code")).alias("codes")))  # one query's terms
    sets = settled(of_query.select("codes").distinct().withColumn("set", F.monotonically_increasing_id()))
    more = [F.col(ahead).cast("double").alias(ahead)] if ahead else []
    met = held.join(F.broadcast(codes), "term").select(F.pmod(F.xxhash64(ident), F.lit(blocks)).alias("block"), ident, "code", "pos", *more)
    each = sets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    schema = f"set long, {ident} {held.schema[ident].dataType.simpleString()}, score double, _tie double"
    found = met.groupBy("block").cogroup(each.groupBy("block")).applyInPandas(_best_of_block(ident, most, ahead), schema)
    best = top_per_group(found, ["set"], [F.desc(F.round("score", 9)), F.desc("_tie"), ident], most, "_r").select("set", ident, "score")
    return of_query.join(sets, "codes").select(query, "set").join(best, "set").select(query, ident, "score")


#: Characters of text that a block of ``cover_density_best`` has about.
BLOCK_CHARS = 32_000_000


def blocks_of(rows: DataFrame, text: str, chars: int = BLOCK_CHARS) -> int:
    """How many blocks the texts make."""
    total = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0  # one number
    return max(1, -(-total // chars))
