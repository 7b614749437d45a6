"""Nearest neighbours: inverted file, product-quantised residuals, asymmetric distances, exact reranking, and a check of what these leave out.

Coarse centroids and the residuals' code books are fitted on at most ``SAMPLE`` vectors, chosen by the hash of their id; every vector is
indexed. A cell's vectors are dealt to chunks by the hash of their id, and each query goes to all chunks of its ``probes`` nearest cells, so a cell
that holds a third of all rows is many tasks. A cell's queries are dealt to blocks likewise, of about ``QUERY_ROWS``, and a task sees one chunk and one block
at a time, whatever the numbers of rows and queries. In a chunk, asymmetric distances rank the codes;
the best ``rerank`` are measured exactly, in double precision, on the original vectors, and the chunk's best k are sent on.

Where codes tell little (close groups far apart, components of very unequal size, many dimensions without structure), the nearest rows can have poor codes or lie in
cells that are not among the nearest. So each row keeps the distance from its code, and each cell the least and largest of its rows' distances from its
centroid. By the triangle inequality these bound how near a row can be: in a chunk, every further row whose bound does not pass the k-th best measured is
measured too, and then each query goes to every further cell whose bound does not pass its k-th best. The result is that of brute force, whatever was
fitted; ``probes`` and ``rerank`` only set what comes first, and where no bound excludes anything, every row is measured.

Among equal distances the smaller ids stay.
Defined results: vectors that are null, zero, or of another length than most, or hold null or non-finite components take no part, as query or
candidate, nor do rows without an id; repeated ids are separate candidates, except a query's own id; of several query rows with one id the least
vector asks; with fewer candidates than k, all are returned; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, PARTS, CODES, CHUNK_ROWS, QUERY_ROWS, STEP = 8_192, 16, 64, 4_096, 2_048, 64
#: Taken off a bound, as a share of the lengths it was computed from: above the rounding of double precision (1e-6 of them at 4,096 dimensions).
MARGIN = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)[None, :] - 2 * x @ c.T


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[a : a + 4096], c).argmin(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def _decoded(m: dict, codes: np.ndarray) -> np.ndarray:
    """The residuals that the codes stand for."""
    out = np.empty((len(codes), m["coarse"].shape[1]))
    for j, (p, b) in enumerate(zip(m["parts"], m["books"], strict=True)):
        out[:, p] = b[codes[:, j]]
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def usable(vector: str, width: int):
    """Column: the vector may take part."""
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == width) & ok & F.exists(v, lambda x: x != 0)


def fit(vectors: np.ndarray, total: int) -> dict:
    """Coarse centroids (about the square root of the rows, at most 1024) and code books of the residuals."""
    cells = int(min(1024, max(1, np.sqrt(total) / 2), max(1, len(vectors) // 8)))
    coarse = _kmeans(vectors, cells)
    rest = vectors - coarse[_nearest(vectors, coarse)]
    parts = np.array_split(np.arange(vectors.shape[1]), min(PARTS, vectors.shape[1]))
    return {"coarse": coarse, "parts": parts, "books": [_kmeans(rest[:, p], CODES) for p in parts]}


def search(
    base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, probes: float = 0.75, rerank: int | None = 256
) -> DataFrame:
    """query_id, rank (from 1), key, score: the k nearest of each query.

    ``probes``: share of the cells that are searched first. ``rerank``: rows of a chunk that are measured first, all if None.
    """
    spark = base.sparkSession
    rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    lengths = rows.filter("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width, total = (lengths["n"], lengths["count"]) if lengths else (0, 0)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", key)
    if not width:
        return empty
    unit = F.pmod(F.xxhash64(F.lit("ann"), F.col("id")), F.lit(10_000_000))
    few = rows.filter(usable("v", width)).filter(unit < int(10_000_000 * min(1.0, 1.2 * SAMPLE / total)) + 1)
    sample = few.orderBy(unit, "id").limit(SAMPLE).select("v").collect()
    if not sample:
        return empty
    model = fit(np.array([r["v"] for r in sample], np.float64), total)
    shared = spark.sparkContext.broadcast(model)
    cells = len(model["coarse"])
    n_probes = max(1, int(np.ceil(cells * probes)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, width)
            cell = _nearest(x, m["coarse"])
            rest = x - m["coarse"][cell]
            codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(m["parts"], m["books"], strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(cell, pa.int32()), pa.array(_lengths(rest)), pa.array(_lengths(rest - _decoded(m, codes))),
                    pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()),
                ],
                names=["id", "cell", "radius", "off", "codes", "raw"],
            )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, width)
            near = np.argsort(_squares(x, m["coarse"]), axis=1, kind="stable")[:, :n_probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "raw", "near"]
            )

    indexed = stored(rows.filter(usable("v", width)).mapInArrow(index, "id long, cell int, radius double, off double, codes binary, raw binary"), "index")
    of_cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("inner"), F.max("radius").alias("outer"))  # at most 1024 rows
    chunks = of_cells.select("cell", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks"))
    chunked = indexed.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null").filter(usable("v", width))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(asked.mapInArrow(route, "query_id long, raw binary, near array<int>"), "asked")

    def probe(rows, asked):
        import pandas as pd

        m = shared.value
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        ids, off = rows["id"].to_numpy(), rows["off"].to_numpy()
        x = np.frombuffer(b"".join(rows["raw"]), np.float64).reshape(len(ids), width)
        coded = _decoded(m, np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(ids), -1))
        lengths = _lengths(coded)
        centre = m["coarse"][int(rows["cell"].iloc[0])]
        count = len(ids) if rerank is None else min(len(ids), max(rerank, k) + 1)
        out = []
        for at in range(0, len(asked), STEP):
            part = asked.iloc[at : at + STEP]
            vectors = np.frombuffer(b"".join(part["raw"]), np.float64).reshape(len(part), width)
            rest = vectors - centre
            own = _lengths(rest)[:, None]
            far = own**2 + _squares(rest, coded)  # the asymmetric distances, squared
            least = np.sqrt(np.maximum(far, 0)) - off - MARGIN * (own + lengths + off)
            for q, v, worst, f, low in zip(part["query_id"], vectors, part["worst"], far, least, strict=True):
                first = np.argpartition(f, count - 1)[:count]
                exact = np.full(len(ids), np.inf)
                exact[first] = _lengths(x[first] - v)
                seen = exact[first][ids[first] != q]
                limit = min(worst, np.partition(seen, k - 1)[k - 1]) if len(seen) >= k else worst
                more = ~(low > limit)  # not a number: measured
                more[first] = False
                more = np.flatnonzero(more)
                exact[more] = _lengths(x[more] - v)
                best = np.concatenate([first, more])
                best = best[(ids[best] != q) & (exact[best] <= limit)]
                top = best[np.lexsort((ids[best], exact[best]))[:k]]
                out.append((np.full(len(top), q), ids[top], exact[top]))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def probed(routed: DataFrame) -> DataFrame:
        """The best of queries (query_id, raw, cell, worst) in their cells: each cell's go out in blocks, and a chunk of rows meets every block in a group of its own."""
        blocks = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))  # a row a cell at most
        left = chunked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = routed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("query_id")), F.col("blocks")).cast("int"))
        right = right.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        found = left.select("cell", "chunk", "block", "id", "off", "codes", "raw").groupBy("cell", "chunk", "block").cogroup(
            right.select("cell", "chunk", "block", "query_id", "raw", "worst").groupBy("cell", "chunk", "block")
        ).applyInPandas(probe, "query_id long, id long, score double")
        return best(found)

    nearest = stored(probed(asked.select("query_id", "raw", F.explode("near").alias("cell"), F.lit(float("inf")).alias("worst"))), "nearest")
    bounds = {r["cell"]: (r["inner"], r["outer"]) for r in of_cells.collect()}
    filled = np.array(sorted(bounds))
    inner, outer = np.array([bounds[c] for c in filled.tolist()]).T

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value["coarse"][filled]
        for batch in batches:
            cells = []
            for raw, near, worst in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                far = _lengths(centres - np.frombuffer(raw, np.float64))
                least = np.maximum(far - outer, inner - far) - MARGIN * (far + outer)
                cells.append(np.setdiff1d(filled[~(least > worst)], near))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "raw", "worst", "cells"]
            )

    worst = nearest.filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    open_to = asked.join(worst, "query_id", "left").select("query_id", "raw", "near", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    left_out = open_to.mapInArrow(further, "query_id long, raw binary, worst double, cells array<int>").filter(F.size("cells") > 0)
    left_out = stored(left_out, "further")
    if not left_out.isEmpty():
        more = probed(left_out.select("query_id", "raw", F.explode("cells").alias("cell"), "worst"))
        nearest = best(nearest.drop("rank").union(more.drop("rank")))
    return nearest.select("query_id", "rank", F.col("id").alias(key), "score")
