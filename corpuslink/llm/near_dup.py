"""MinHash near-duplicates by an LSH forest.

1. One pass over the texts makes, per document, the fingerprint of its shingle set, ``HASHES``
   MinHash values and a sketch: the parities of its shingles in ``BITS`` classes. Documents with the same set collapse to one set, which gets a number of its own, before anything else.
2. The forest: each of ``TREES`` orders sorts the sets by a signature of ``LEVELS`` values that starts at another place.
   Sorting is a range shuffle on (order, signature, id), so no group of copies is one key. A candidate of a
   set is a neighbour in some order with which it shares the first ``LEAST`` values: in a sparse region that is every
   set with the same prefix; in a crowded one, at first, the neighbour, which shares the longest
   prefix there, and the region's least set so far, the same in most orders; step 5 does the rest.
   So a set has at most ``2 * TREES`` candidates there, however large its group is.
3. Candidates whose set sizes, sketches or signatures rule the similarity out are dropped; the others are confirmed on whole shingle sets: first each set with its candidate of smallest id,
   which joins most of a group of copies to one set, then every candidate pair that this left apart.
4. Connected components by large-star and small-star steps, checkpointed.
5. Crowded regions that hold several components are searched whole: all pairs of sets of different components by sketches and signatures, and
   where a pair may belong, all pairs of such sets on whole shingle sets. The sets outside a region's largest component are dealt in blocks,
   which the region's sets visit in slices. There are at most ``SPREAD`` blocks, and copies of a block for as many slices, however large the
   region is: beyond ``SPREAD * BLOCK`` sets the blocks grow, so the rows dealt grow with the sets. Only where a block would
   weigh over ``HELD`` bytes (60,000 sets by signatures, 500,000 shingles with their index on whole sets) are there more of them.
   A task returns a spanning forest of the links it finds, so rows out grow with the sets, too.

Memory and shuffles: whole texts are shuffled for documents with candidates, and whole sets a few times where step 5 compares them; everything
else is ids, sketches and signatures. A crowd of m sets that stay apart takes m * m comparisons a region. Chance of a miss: a pair of similarity s agrees on a tree's prefix with probability
s**LEAST, so at 0.8 it is missed by all 32 trees with 0.59**32, below 1e-7.

Defined results: null, empty or blank texts have no shingles, form their own component and are kept; repeated rows give one row each; rows of
one id with different texts are documents of their own, each in its text's component; a component of null ids only has a null id, others ignore
null ids, and ``kept`` compares null-safe. Ids may be of any type that sorts. Words are split at ASCII white space and lower-cased in A-Z only;
an empty table gives an empty table. Other columns are ignored by ``near_duplicates`` and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, discard, stored

HASHES, TREES, LEAST, LEVELS, NEAR, SLACK, BLOCK, SPREAD, SALT = 128, 32, 4, 10, 3, 0.2, 256, 8, 16
#: Classes of a sketch, and the bytes of sets that a block of step 5 holds.
BITS, HELD = 1024, 2**24
#: Bytes of a path: a hash of the first LEAST values, then two of each further one.
PREFIX, WIDTH = 8, 8 + 2 * (LEVELS - LEAST)
WORDS_CACHE = 150_000
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; with fewer words, the whole sequence is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    x = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(_mix(x + np.uint64(size)))


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values: the least of the top 32 bits of each multiple of the set's hashes."""
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 2048):
        part = (s[at : at + 2048, None] * MULTIPLY[None, :]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=0).astype(np.uint32))
    return best


def sketch(s: np.ndarray) -> bytes:
    """The parities of the numbers of hashes in BITS classes."""
    return np.packbits(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def sketches(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, BITS // 64)


def alike(p: np.ndarray, q: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sketches, and of these sums of two sizes, may be similar; none that is gets False.

    Sketches differ in no more classes than sets have elements that the other lacks, and similar sets have few of these.
    """
    return (100 + percent) * np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= (100 - percent) * sizes


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: k (its id), t (hash of its text), n (set size), fp (fingerprint of the set), sig (MinHash values, big-endian), low (their low bytes), odd (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sig, low, odd = [], [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                fp.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                m = minhash(s) if len(s) else None
                sig.append(None if m is None else m.astype(">u4").tobytes())
                low.append(None if m is None else m.astype(np.uint8).tobytes())
                odd.append(None if m is None else sketch(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (fp, sig, low, odd))],
                names=["k", "t", "n", "fp", "sig", "low", "odd"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), text).mapInArrow(run, f"k {kind}, t long, n long, fp binary, sig binary, low binary, odd binary")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row a set of ``signatures``: id (a number of its own), first (the least row that has it: no_id, k, t), n, fp, sig, low, odd."""
    first = F.struct(F.col("k").isNull().alias("no_id"), "k", "t")
    same = [F.first(c).alias(c) for c in ("n", "sig", "low", "odd")]  # functions of the set
    by_set = rows.filter("fp is not null").groupBy("fp").agg(F.min(first).alias("first"), *same)
    return by_set.withColumn("id", F.monotonically_increasing_id())


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = (np.arange(TREES)[:, None] * LEAST + np.arange(LEVELS)[None, :]) % HASHES
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u4").reshape(part.num_rows, HASHES)
            values = sig[:, places].astype(np.uint64).reshape(-1, LEVELS)
            prefix = np.full(len(values), 7, np.uint64)
            for k in range(LEAST):
                prefix = _mix(prefix * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
            rows = np.concatenate([prefix[:, None].view(np.uint8), values[:, LEAST:].astype(">u2").view(np.uint8)], axis=1)
            data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
            offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * WIDTH, WIDTH, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)),
                    pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, data]),
                    pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), TREES)),
                ],
                names=["tree", "path", "id"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: pairs of sets close in one order, the rows at the partition's two ends (a is null), and the rows
    of regions that are crowded or go on in another partition (b is null)."""
    held: list[tuple[int, bytes, int]] = []  # the last NEAR rows
    first: list[tuple[int, bytes, int]] = []
    region: tuple[int, bytes] | None = None
    pivot = seen = 0
    few: list[tuple[int, int, bytes]] | None = None  # rows of a region that is not crowded so far
    for batch in batches:
        a, b, crowd = [], [], []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree, path, i = row
            here = (tree, path[:PREFIX])
            if here != region:
                few = None if region is None else []
                region, pivot, held, seen = here, i, [], 1
            else:
                seen += 1
                # From here on the region is crowded: the nearest row and the pivot, as step 5 searches the rest.
                for j in [r[2] for r in held] if seen <= NEAR + 1 else {held[-1][2], pivot}:
                    a.append(i)
                    b.append(j)
                pivot = min(pivot, i)
            if few is None:
                crowd.append((i, *here))
            else:
                few.append((i, *here))
                if len(few) > NEAR + 1:
                    crowd, few = crowd + few, None
            held = [*held[1 - NEAR :], row] if len(held) == NEAR else [*held, row]
            if len(first) < NEAR:
                first.append(row)
        if a:
            yield _pairs(a, b)
        if crowd:
            yield _crowd(crowd)
    if few:
        yield _crowd(few)
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(first) + len(held), pa.int64()),
            pa.array([r[2] for r in first + held], pa.int64()),
            pa.array([r[0] for r in first + held], pa.int32()),
            pa.array([r[1] for r in first + held], pa.binary()),
        ],
        names=["a", "b", "tree", "path"],
    )


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    lo, hi = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays(
        [pa.array(hi), pa.array(lo), pa.nulls(len(lo), pa.int32()), pa.nulls(len(lo), pa.binary())], names=["a", "b", "tree", "path"]
    )


def _crowd(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    i, tree, path = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int64()), pa.nulls(len(i), pa.int64()), pa.array(tree, pa.int32()), pa.array(path, pa.binary())], names=["a", "b", "tree", "path"]
    )


PAIR_SCHEMA = "a long, b long, tree int, path binary"


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a > b, of sets (id, sig) that are neighbours in the forest; rows (tree, path, id) of crowded regions."""
    trees = sets.select("id", "sig").mapInArrow(_tree_rows, "tree int, path binary, id long")
    ranged = trees.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    found = stored(ranged.mapInArrow(_neighbours, PAIR_SCHEMA), "forest")
    inside = found.filter("a is not null and b is not null").select("a", "b")
    crowds = found.filter("a is not null and b is null").select("tree", "path", F.col("a").alias("id"))
    # Where one partition ends and the next begins: a few rows a partition.
    edges = found.filter("a is null").select("tree", "path", F.col("b").alias("id")).distinct()
    near = Window.partitionBy("tree", F.substring("path", 1, PREFIX)).orderBy("path", "id")
    across = edges.select("id", *[F.lead("id", k).over(near).alias(f"n{k}") for k in range(1, NEAR + 1)])
    across = across.select("id", F.explode(F.array(*[f"n{k}" for k in range(1, NEAR + 1)])).alias("o")).filter("o is not null and o != id")
    return inside.union(across.select(F.greatest("id", "o").alias("a"), F.least("id", "o").alias("b"))).distinct(), crowds


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and sketches allow the similarity and whose signatures agree in at least that share less SLACK.

    The low bytes of 128 values agree in 0.8 of them on average at a similarity of 0.8, with a deviation of 0.035: a pair that belongs
    is dropped with a chance below 1e-7.
    """
    least = HASHES * (percent / 100 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES) for c in batch.columns[2:4])
            may = alike(*(sketches(c.to_pylist()) for c in batch.columns[4:6]), batch.column(6).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(may & ((p == q).sum(axis=1) >= least)))

    side = lambda end: sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "low", "odd")])
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    both = both.select("a", "b", "low_a", "low_b", "odd_a", "odd_b", (F.col("n_a") + F.col("n_b")).alias("sizes"))
    return both.mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, sets: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Whole shingle sets (id, s) of the ``sets`` in ``ids``, from the first row of each; these have no bound, so they are never broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shingles(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=["id", "s"])

    wanted = sets.join(ids, "id").select("id", F.xxhash64("first.k").alias("h"), F.col("first.t").alias("t"))
    rows = docs.select(F.xxhash64(key).alias("h"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    chosen = rows.join(wanted.hint("merge"), ["h", "t"]).dropDuplicates(["h", "t"])
    return chosen.select("id", "text").mapInArrow(run, "id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(p), len(q)))
                if 100 * least < percent * most:
                    keep.append(False)
                    continue
                both = least + most - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * both >= percent * (least + most - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), "s"), "a")
    return two.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id connected with each end of ``edges`` (a, b), a > b.

    Large-star and small-star steps until the edges stay the same; every step is checkpointed. Sums by ends are
    aggregated before the shuffle, so a vertex with very many edges is no burden to one task.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def dealt(members: DataFrame, data: DataFrame, weight: Column) -> DataFrame:
    """Rows (tree, path, block, visitor, own, id, component) of regions with several components, with the columns of ``data`` (by id).

    The sets outside a region's largest component are residents, in one block each, with a copy for each slice of the visitors; ``weight`` is their
    bytes. Any two members of different components meet in one block: as residents of it, one of which is there on its own account (own), or one as
    a visitor. Rows of a block follow each other, visitors last.
    """
    by = ["tree", "path"]
    sizes = members.groupBy(*by, "component").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    most = lambda c: F.max_by(c, F.struct("n", "component"))
    regions = sizes.groupBy(*by).agg(
        F.sum("n").alias("m"), F.count("*").alias("k"), most("component").alias("major"), (F.sum("n") - most("n")).alias("few"), (F.sum("w") - most("w")).alias("w")
    )
    parts = F.greatest(F.least(F.lit(SPREAD), F.ceil(F.col("few") / BLOCK)), F.ceil(F.col("w") / HELD)).cast("int")
    # Slices for about SPREAD tasks, or as many as cost no more copies of residents than there are visitors.
    slices = F.greatest(F.ceil(F.least(F.lit(SPREAD), F.col("m") / BLOCK) / F.col("parts")), F.floor(F.col("m") / F.greatest("few", F.lit(BLOCK)))).cast("int")
    # Large regions are spread over SALT keys.
    regions = regions.filter("k > 1").withColumn("parts", parts).withColumn("slices", slices)
    regions = regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hashed = F.xxhash64("id")
    inside = members.withColumn("salt", F.pmod(hashed, F.lit(SALT)).cast("int")).join(regions, [*by, "salt"])
    parts, slices = F.col("parts"), F.col("slices")
    home, own = F.pmod(F.shiftright(hashed, 8), parts).cast("int"), F.pmod(F.shiftright(hashed, 32), slices).cast("int")
    block = lambda part, piece: (part * slices + piece).alias("block")
    stay = F.transform(F.sequence(F.lit(0), slices - 1), lambda x: F.struct(block(home, x), F.lit(0).alias("visitor"), (x == own).cast("int").alias("own")))
    visit = lambda part: F.struct(block(part, own), F.lit(1).alias("visitor"), F.lit(1).alias("own"))
    # Of two residents' parts one is within half a turn of the other.
    turn = F.filter(F.sequence(F.lit(0), F.floor(parts / 2).cast("int")), lambda x: x > 0)
    places = F.when(F.col("component") == F.col("major"), F.transform(F.sequence(F.lit(0), parts - 1), visit)).otherwise(
        F.concat(stay, F.transform(turn, lambda x: visit(F.pmod(home + x, parts))))
    )
    rows = inside.select(*by, "id", "component", F.explode(places).alias("at")).select(*by, "at.*", "id", "component")
    return rows.join(data, "id").repartition(*by, "block").sortWithinPartitions(*by, "block", "visitor")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bytes], bool, list[tuple]]]:
    """Of sorted rows (tree, path, block, visitor, ...): region, whether residents (all of a block) or visitors (some), and the rest of each row.

    Blocks without residents are left out.
    """
    key, rows, home = None, [], None
    for batch in batches:
        for tree, path, block, visitor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (tree, path, block, visitor)
            if rows and (now != key or visitor and len(rows) == 64):
                yield key[:2], bool(key[3]), rows
                rows = []
            key = now
            if not visitor:
                home = now[:3]
            if home == now[:3]:
                rows.append(row)
    if rows:
        yield key[:2], bool(key[3]), rows


def hopeful(rows: DataFrame, percent: int) -> DataFrame:
    """(tree, path, id, n) of dealt rows that sizes, sketches and signatures let be similar to one of another component."""
    least = HASHES * (percent / 100 - SLACK)

    def arrays(part: list[tuple]) -> tuple[np.ndarray, ...]:
        own, i, c, n, low, odd = zip(*part, strict=True)
        return np.array(own, bool), np.array(i), np.array(c), np.array(n), np.frombuffer(b"".join(low), np.uint8).reshape(-1, HASHES), sketches(odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, path), visitors, part in _blocks(batches):
            own, *rest = arrays(part)
            if not visitors:
                i, c, n, low, odd = rest
            come = [x[own] for x in rest]
            came, met, step = np.zeros(len(come[0]), bool), np.zeros(len(i), bool), max(1, 2**20 // len(i))
            for start in range(0, len(came), step):
                _, y, z, own_low, own_odd = (x[start : start + step] for x in come)
                u, v = np.nonzero((c[None] != y[:, None]) & (100 * np.minimum(n[None], z[:, None]) >= percent * np.maximum(n[None], z[:, None])))
                for at in range(0, len(u), 8192):
                    p, q = u[at : at + 8192], v[at : at + 8192]
                    may = alike(own_odd[p], odd[q], z[p] + n[q], percent)
                    p, q = p[may], q[may]
                    may = (own_low[p] == low[q]).sum(axis=1) >= least
                    came[start + p[may]], met[q[may]] = True, True
            found, size = np.concatenate([come[0][came], i[met]]), np.concatenate([come[2][came], n[met]])
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(found), pa.int32()), pa.array([path] * len(found), pa.binary()), pa.array(found), pa.array(size)],
                    names=["tree", "path", "id", "n"],
                )

    ready = rows.select("tree", "path", "block", "visitor", "own", "id", "component", "n", "low", "odd")
    return ready.mapInArrow(run, "tree int, path binary, id long, n long").distinct()


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): of dealt rows with whole sets, links that join all components that similar sets of one block join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, visitors, part in _blocks(batches):
            if not visitors:  # postings of the residents' shingles
                ids, of = [r[1] for r in part], np.array([r[2] for r in part])
                s = [np.frombuffer(r[3], np.uint64) for r in part]
                n = np.array([len(x) for x in s])
                all_of, who = np.concatenate(s), np.repeat(np.arange(len(s)), n)
                order = np.argsort(all_of, kind="stable")
                values, starts, counts = np.unique(all_of[order], return_index=True, return_counts=True)
                who, root = who[order], {}
            a, b = [], []
            for own, i, c, t in part:
                if not own:
                    continue
                t = np.frombuffer(t, np.uint64)
                c = root.get(c, c)
                if (of == c).all():
                    continue
                at = np.minimum(np.searchsorted(values, t), len(values) - 1)
                at = at[values[at] == t]
                ends = np.cumsum(counts[at])
                places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + counts[at], counts[at])
                both = np.bincount(who[places], minlength=len(ids))
                for j in np.nonzero(100 * both >= percent * (n + len(t) - both))[0]:
                    if of[j] != c:
                        a.append(max(i, ids[j]))
                        b.append(min(i, ids[j]))
                        old = of[j]
                        of[of == old] = c
                        root = {k: c if r == old else r for k, r in root.items()} | {old: c}
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("tree", "path", "block", "visitor", "own", "id", "component", "s").mapInArrow(run, "a long, b long").distinct()


def labelled(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per row of ``docs``: k, t, n, fp, and best, the least (no_id, k, t) of its component; best is null for rows without shingles."""
    rows = stored(signatures(docs, key, text, size), "signatures")
    sets = stored(distinct_sets(rows), "distinct")
    near, crowds = candidates(sets)
    pairs = stored(plausible(near, sets, percent), "candidates")
    # Each end is aggregated by itself: in a crowded region a set has up to TREES * (NEAR + 1) pairs, but is one id.
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    whole = stored(_texts_of(docs, sets, ids, key, text, size), "sets")
    first = stored(confirmed(pairs.groupBy("a").agg(F.min("b").alias("b")), whole, percent), "links")
    # One step towards the smallest: pairs that this already joins need no test.
    label = first.alias("x").join(first.alias("y"), F.col("x.b") == F.col("y.a"), "left").select(
        F.col("x.a").alias("id"), F.coalesce(F.col("y.b"), F.col("x.b")).alias("label")
    )
    of = lambda end: label.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    )
    rest = confirmed(apart.select("a", "b").join(first, ["a", "b"], "left_anti"), whole, percent)
    joined = components(first.union(rest))
    discard(whole, pairs, first)
    members = stored(crowds.join(joined, "id", "left").select("tree", "path", "id", F.coalesce("component", "id").alias("component")), "crowds")
    marks = HASHES + BITS // 8 + 24
    hope = stored(hopeful(dealt(members, sets.select("id", "n", "low", "odd"), F.lit(marks)), percent), "hopeful")
    if not hope.isEmpty():
        few = stored(_texts_of(docs, sets, hope.select("id").distinct(), key, text, size), "sets")
        more = stored(linked(dealt(members.join(hope, ["tree", "path", "id"]), few, 32 * F.col("n")), percent), "links")
        joined = joined if more.isEmpty() else components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        discard(few)
    discard(members)
    numbered = sets.select("id", "fp", "first").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A large component is SALT keys: its members' least rows are gathered a salt, and the least of these goes back to the salts.
    numbered = numbered.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    part = numbered.groupBy("component", "salt").agg(F.min("first").alias("least"))
    best = part.select("component", "salt").join(part.groupBy("component").agg(F.min("least").alias("best")), "component")
    return rows.select("k", "t", "n", "fp").join(numbered.join(best, ["component", "salt"]).select("fp", "best"), "fp", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id, kept."""
    out = labelled(docs, key, text, size, percent)
    component = F.when(F.col("best").isNull(), F.col("k")).otherwise(F.col("best.k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, and of several with this id the one of least text hash.

    Documents without shingles all stay; of rows repeated in id and text, one does.
    """
    out = labelled(docs, key, text, size, percent)
    keep = out.filter("best is null or (k <=> best.k and t = best.t)").select(F.xxhash64("k").alias("h"), "t").distinct()
    rows = docs.select(F.xxhash64(key).alias("h"), F.xxhash64(text).alias("t"), F.struct("*").alias("doc"))
    return rows.join(keep, ["h", "t"], "left_semi").dropDuplicates(["h", "t"]).select("doc.*")
