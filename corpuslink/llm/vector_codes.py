"""Vector code compression: Lloyd's rounds over cover trees that stay inside their partition.

Vectors are cut into equal parts, and each part position has a codebook of its own. Every partition deals its rows into
blocks of at most ``BLOCK`` vectors and builds one cover tree per block and part: each node is a ball around one of its
points, its children are balls of half the radius whose centres are that far apart, and its points are one run of the
block's order, so that the difference of two running sums is the sum of any subtree. Trees are written once. A round
walks them from the root: a ball whose nearest entry is nearer to all its points than any other entry can be, by the
triangle inequality, goes to it whole, with its sum; entries that are too far for every point of a ball are forgotten
below it; only balls that stay ambiguous go on to their children, and at last to exact comparisons of single points.
A partition hands on one row for each entry and part; entries are few (``parts * entries``), so they alone reach the driver.

All arithmetic on distances is exact: components are integers, and squared distances stay below 2**53, else ValueError.
The radii are floating-point and only ever used with a margin.

Memory of a task: a few blocks, each about ``BLOCK`` vectors, and a matrix of ``BLOCK`` by ``entries`` distances. Time to build a
tree is ``BLOCK`` distances a vector at most. A group of equal vectors is one ball of radius zero, whatever its size.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; fewer kept rows than
entries give a shorter codebook; repeated keys are rows of their own (where the first codebook is cut between them, smaller
vectors come first); null keys come last; null labels are one label; equal entries are used by the
lowest index only; an empty table gives an empty table. A width that is no multiple of ``parts``, or vectors of different widths,
raise ValueError. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors of one cover tree; balls of at most ``LEAF`` points have no children; parts of a label's sum.
BLOCK, LEAF, SALTS = 2048, 8, 16


def usable(vector: str) -> Column:
    """The vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Usable rows with integer components: key, label, v."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return df.filter(usable(vector)).select(F.col(key).alias("key"), F.col(label).alias("label"), whole.alias("v"))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: integers below 2**53 held as doubles."""
    p, c = points.astype(np.float64), entries.astype(np.float64)
    return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]


@dataclass
class CoverTree:
    """Points in tree order and, per node, its run of points, radius and run of children; a node's centre is the first of its points."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """Halve the radius level by level; the next centre is always the point farthest from those chosen so far."""
        runs, nodes = [np.arange(len(points))], []
        place = 0
        while place < len(runs):
            own, place = runs[place], place + 1
            away = np.sqrt(distances(points[own], points[own[:1]])[:, 0])
            radius, first = float(away.max()), len(runs)
            nodes.append((own, radius, first))
            if radius == 0 or len(own) <= LEAF:
                continue
            near, nearest, centre, centres = away, np.zeros(len(own), np.int64), 0, [0]
            while near[far := int(near.argmax())] > radius / 2:
                centre += 1
                centres.append(far)
                away = np.sqrt(distances(points[own], points[own[far : far + 1]])[:, 0])
                closer = away < near
                near, nearest = np.where(closer, away, near), np.where(closer, centre, nearest)
            for k, c in enumerate(centres):
                inside = own[nearest == k]
                runs.append(np.concatenate([own[c : c + 1], inside[inside != own[c]]]))
        # Nodes were met level by level; a run's place in tree order follows from those before it.
        start, end = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        child, children = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        at = 1
        for i, (own, _, first) in enumerate(nodes):
            end[i] = start[i] + len(own)
            child[i], begins = first, start[i]
            while at < len(nodes) and at < (nodes[i + 1][2] if i + 1 < len(nodes) else len(nodes)):
                start[at] = begins
                begins += len(nodes[at][0])
                children[i] += 1
                at += 1
        order = np.empty(len(points), np.int64)
        for i in np.flatnonzero(children == 0):
            order[start[i] : end[i]] = nodes[i][0]
        return cls(order, points[order], start, end, np.array([r for _, r, _ in nodes]), child, children)

    def assigned(self, book: np.ndarray) -> np.ndarray:
        """Index of each point's nearest entry, ties to the lowest, in tree order; whole balls at a time where one entry is sure to win."""
        own = np.sort(np.unique(book, axis=0, return_index=True)[1])  # equal entries: the first alone
        entries = book[own]
        out = np.empty(len(self.points), np.int64)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(nodes):
            d = np.sqrt(distances(self.points[self.start[nodes]], entries))
            d[~open_] = np.inf
            best = d.min(1)
            reach = best + 2 * self.radius[nodes]
            open_ = d <= (reach + 1e-9 * (1 + reach))[:, None]
            sure = open_.sum(1) == 1
            for n, e in zip(nodes[sure], open_[sure].argmax(1), strict=True):
                out[self.start[n] : self.end[n]] = e
            leaf = ~sure & (self.children[nodes] == 0)
            if leaf.any():
                sizes = self.end[nodes[leaf]] - self.start[nodes[leaf]]
                at = np.repeat(self.start[nodes[leaf]] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
                exact = distances(self.points[at], entries)
                exact[~np.repeat(open_[leaf], sizes, axis=0)] = np.inf
                out[at] = exact.argmin(1)
            down = ~sure & ~leaf
            sizes = self.children[nodes[down]]
            open_ = np.repeat(open_[down], sizes, axis=0)
            nodes = np.repeat(self.child[nodes[down]] - np.concatenate([[0], sizes.cumsum()[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())
        return own[out]

    def sums(self, assigned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum per entry, from differences of running sums where the entry changes."""
        running = np.vstack([np.zeros((1, self.points.shape[1]), np.int64), self.points.cumsum(0)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(assigned)) + 1, [len(assigned)]])
        which = assigned[cuts[:-1]]
        count, total = np.zeros(n, np.int64), np.zeros((n, self.points.shape[1]), np.int64)
        np.add.at(count, which, np.diff(cuts))
        np.add.at(total, which, running[cuts[1:]] - running[cuts[:-1]])
        return count, total


TREE = "struct<ord:array<int>,pts:array<long>,lo:array<int>,hi:array<int>,radius:array<double>,child:array<int>,children:array<int>>"

ARROW = pa.list_(pa.struct({n: pa.list_({"pts": pa.int64(), "radius": pa.float64()}.get(n, pa.int32())) for n in ("ord", "pts", "lo", "hi", "radius", "child", "children")}))


def packed(t: CoverTree) -> dict:
    return {"ord": t.order, "pts": t.points.ravel(), "lo": t.start, "hi": t.end, "radius": t.radius, "child": t.child, "children": t.children}


def unpacked(x: dict) -> CoverTree:
    ints = {k: np.asarray(x[k], np.int64) for k in ("ord", "pts", "lo", "hi", "child", "children")}
    return CoverTree(ints["ord"], ints["pts"].reshape(len(ints["ord"]), -1), ints["lo"], ints["hi"], np.asarray(x["radius"], float), ints["child"], ints["children"])


def planted(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """A row per block: keys and labels of its vectors, and its cover trees."""
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("key", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                lists = b.column("v")
                if set(np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))) != {width}:
                    raise ValueError(f"vectors must all have {width} components")
                v = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if float(np.abs(v.astype(np.float64)).max()) ** 2 * 4 * width >= 2**53:
                    raise ValueError("components are too large for exact distances")
                trees = [packed(CoverTree.build(p)) for p in np.split(v, parts, axis=1)]
                held = [pa.ListArray.from_arrays([0, b.num_rows], b.column(n)) for n in ("key", "label")]
                yield pa.RecordBatch.from_arrays([*held, pa.array([trees], ARROW)], names=["keys", "labels", "trees"])

    return rows.mapInArrow(run, f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, trees array<{TREE}>")


def refined(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One of Lloyd's rounds: entries become the floors of their parts' means; unused ones stay."""
    parts, n, width = len(books), len(books[0]), books[0].shape[1]
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            for trees_of in batch.column(0):
                for p, x in enumerate(trees_of.as_py()):
                    t = unpacked(x)
                    c, s = t.sums(t.assigned(books[p]), n)
                    count[p] += c
                    total[p] += s
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, i]) for i in range(width)]], names=["part", "entry", "n", *names])

    sums = trees.select("trees").mapInArrow(run, "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names))
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():  # parts * entries rows at most
        out[r["part"]][r["entry"]] = [r[s] // r["n"] for s in names]
    return out


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Per vector: key, label, code and error."""
    kinds = {n: trees.schema[n].dataType.elementType.simpleString() for n in ("keys", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, labels = batch.column(0).slice(row, 1).flatten(), batch.column(1).slice(row, 1).flatten()
                codes, error = np.zeros((len(keys), len(books)), np.int64), np.zeros(len(keys), np.int64)
                for p, x in enumerate(batch.column(2)[row].as_py()):
                    t = unpacked(x)
                    found = t.assigned(books[p])
                    codes[t.order, p] = found
                    error[t.order] += ((t.points - books[p][found]) ** 2).sum(1)
                text = ["".join(digits[i] for i in c) for c in codes.tolist()]
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(text), pa.array(error)], names=["key", "label", "code", "error"])

    places = max(2, len(f"{len(books[0]) - 1:x}"))
    digits = [f"{i:0{places}x}" for i in range(len(books[0]))]
    return trees.select("keys", "labels", "trees").mapInArrow(run, f"key {kinds['keys']}, label {kinds['labels']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def learned(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The stored trees and the codebooks after ``rounds`` rounds; no tree where no row is usable."""
    rows = scaled(df, key, vector, label, scale)
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("key"), "v").limit(entries).select("v").collect()]  # `entries` rows at most
    if not first:
        return None, []
    width = len(first[0])
    if width == 0 or width % parts or any(len(v) != width for v in first):
        raise ValueError(f"vectors must have one width, a multiple of {parts}")
    trees = stored(planted(rows, parts, width), "cover_trees")
    books = np.split(np.array(first, np.int64), parts, axis=1)
    for _ in range(rounds):
        books = refined(trees, books)
    return trees, books


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Per usable row: key, code, error, label_error, codebooks_sha256. ``options``: those of ``learned``."""
    trees, books = learned(df, key, vector, label, **options)
    if trees is None:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = stored(coded(trees, books), "codes")
    # A label may hold any share of the rows: its sum is made before the shuffle and joined in SALTS copies.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list[np.ndarray], code: str = "code", scale: int = 1024) -> DataFrame:
    """``codes`` with ``vector``: the codebooks' entries that the code names, back at the original scale."""
    places = max(2, len(f"{len(books[0]) - 1:x}"))
    tables = [F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b.tolist()]) for b in books]
    part = lambda p: F.conv(F.substring(code, p * places + 1, places), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(t, part(p)) for p, t in enumerate(tables)]))
