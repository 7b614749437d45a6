"""Vector candidates by bucketed random projections: nearest rows by cosine without meeting every row.

Unit vectors are projected on random lines and cut into buckets (the ``BucketedRandomProjectionLSH`` of Spark ML makes the projections); each of
``tables`` keys puts ``lines`` buckets together. Rows and queries meet on equal keys; a query also asks the keys one bucket aside on
any one line, so few tables do. Blocks of rows meet the queries in a task each, where candidates are told by keys and their cosines computed, exactly;
k rows a query leave the task, so that candidates are neither shuffled nor stored.
A query that finds fewer than k candidates is answered by all rows, in blocks, so no result is ever short.

How much is met follows the data and ``width``, which should be some times the spread of near vectors along a line: of 60 clusters a query meets less than 5 %
of the rows; of vectors without any structure, such as the given tables' (64 random directions), about half for nine tenths of the true neighbours.

Defined results: null and zero vectors, and those of another length than the query's, take no part; a query is not its own neighbour; ties go to the
smaller id; repeated ids are rows of one id and answered once; an empty side gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from .search import firsts, vector_hits

#: Rows and queries of a block.
ROWS, QUERIES = 65_536, 65_536


def unit(vector: Column) -> Column:
    """The vector scaled to length 1, in double precision; null if null, empty, zero, or with null or non-finite components."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return once(norm, lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n)))


def keyed(rows: DataFrame, vector: str, tables: int, lines: int, width: float, seed: int) -> DataFrame:
    """``rows`` with ``h``: for every table, the array of its lines' buckets. ``vector``: unit vectors of one length."""
    lsh = BucketedRandomProjectionLSH(inputCol="_x", outputCol="_h", bucketLength=width, numHashTables=tables * lines, seed=seed)
    ready = rows.withColumn("_x", array_to_vector(vector))
    flat = F.transform("_h", lambda v: F.get(vector_to_array(v), F.lit(0)).cast("int"))
    dealt = once(flat, lambda x: F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.slice(x, t * lines + 1, F.lit(lines))))
    return lsh.fit(ready).transform(ready).withColumn("h", dealt).drop("_x", "_h")


def _keys(h: Column) -> Column:
    return F.transform(h, lambda b, t: F.xxhash64(t, b))


def _probes(h: Column, lines: int) -> Column:
    """Keys of each table's bucket and of those one step aside on one line."""
    moves = F.sequence(F.lit(0), F.lit(2 * lines))
    aside = lambda b, m: F.transform(b, lambda x, i: x + F.when(m == 2 * i + 1, 1).when(m == 2 * i + 2, -1).otherwise(0))
    return F.flatten(F.transform(h, lambda b, t: F.transform(moves, lambda m: F.xxhash64(t, aside(b, m)))))


def _meeting(keys: np.ndarray, probes: np.ndarray, tables: int):
    """Which rows (their keys, a column a table) share a key with queries (their keys, as many for each table), for numbers of queries."""
    orders = [np.argsort(keys[:, t], kind="stable") for t in range(tables)]
    rising = [keys[o, t] for t, o in enumerate(orders)]
    wide = probes.shape[1] // tables

    def met(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), len(keys)), bool)
        for t in range(tables):
            want = probes[some, t * wide : (t + 1) * wide].ravel()
            low, high = np.searchsorted(rising[t], want), np.searchsorted(rising[t], want, side="right")
            sizes = high - low
            place = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            out[np.repeat(np.arange(len(want)) // wide, sizes), orders[t][place]] = True
        return out

    return met


def _near_in_block(k: int, tables: int):
    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"q": asked["q"].iloc[:0], "id": held["id"].iloc[:0], "score": np.empty(0)})]
        if len(held) and len(asked):
            held = held.assign(_v=held["v"].map(tuple)).drop_duplicates(["id", "_v"], ignore_index=True) if held["id"].duplicated().any() else held
            met = _meeting(np.stack(held["keys"].to_numpy()), np.stack(asked["keys"].to_numpy()), tables)
            parts.extend(firsts(held, asked, k, met, 12))
        return pd.concat(parts)

    return best


def near_vectors(
    rows: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, k: int, tables: int = 24, lines: int = 8, width: float = 0.35, seed: int = 7
) -> DataFrame:
    """(query, ident, score, r): of every query the k candidates of greatest cosine, r from 1."""
    asked = queries.select(F.col(query).alias("q"), unit(F.col(vector)).alias("qv")).filter("qv is not null").dropDuplicates(["q"])
    held = rows.select(F.col(ident).alias("id"), unit(F.col(vector)).alias("v")).filter("v is not null")
    if asked.isEmpty() or held.isEmpty():
        return held.limit(0).join(asked.limit(0)).select(F.col("q").alias(query), F.col("id").alias(ident), F.lit(0.0).alias("score"), F.lit(0).alias("r"))
    size = asked.select(F.size("qv")).first()[0]
    n, m = max(1, -(-held.count() // ROWS)), max(1, -(-asked.count() // QUERIES))  # two numbers
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    known = keyed(held.filter(F.size("v") == size), "v", tables, lines, width, seed).select("id", "v", _keys(F.col("h")).alias("keys"), part("id", n).alias("a")).withColumn("b", each(m))
    asking = keyed(asked.filter(F.size("qv") == size), "qv", tables, lines, width, seed).select("q", F.col("qv").alias("v"), _probes(F.col("h"), lines).alias("keys"), part("q", m).alias("b"))
    schema = f"q {asked.schema['q'].dataType.simpleString()}, id {held.schema['id'].dataType.simpleString()}, score double"
    best = known.groupBy("a", "b").cogroup(asking.withColumn("a", each(n)).groupBy("a", "b")).applyInPandas(_near_in_block(k, tables), schema)
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "id"))
    found = best.withColumn("r", order).filter(F.col("r") <= k)
    short = asked.join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left").filter(F.coalesce("n", F.lit(0)) < k).select("q", "qv")
    rest = vector_hits(held, short.select("q", F.col("qv").alias("v")), "id", "q", "v", k).withColumn("r", order)
    out = found.join(short.select("q"), "q", "left_anti").select("q", "id", "score", "r").union(rest.select("q", "id", "score", "r"))
    return out.select(F.col("q").alias(query), F.col("id").alias(ident), "score", "r")
