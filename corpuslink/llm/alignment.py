"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the bytes of one text; where tokens of both end, a group ends. ``cuts`` compares the two arrays of end
offsets along a diagonal: at the current index shift it probes stretches that double in length until they differ, so a
one-to-one stretch is jumped in a few slice comparisons; where the ends differ it walks the one group that is irregular,
and goes on at the shift which that group leaves behind.

Spark deals out whole documents. A first pass encodes and aligns them once and writes, per document, its counts, its digest and
its linked id pairs with how often it holds them. The corpus-wide counts of pairs are one aggregation, summed before
the shuffle. A second pass looks up the pairs of ``1/HEAVY`` of all links and more (fewer than ``HEAVY`` pairs, whatever
the corpus) in a broadcast table, so no frequent pair is a hot key; the rare rest is joined by a shuffle.

Memory of a task: both tokenizers, one group of texts, at most about twice ``CHUNKS`` aligned chunks, and the frequent pairs.

Defined results: null or empty texts, and texts whose bytes either tokenizer changes (normalised, or U+2581 in them), have no
tokens: zeros and an empty digest; repeated rows are aligned and counted one by one; a text of any length is aligned
whole; ties for the highest count are all best; keys may be of any type; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Chunks kept before they become the old generation; pairs are frequent with more than 1/HEAVY of all links.
CHUNKS, HEAVY = 250_000, 50_000
#: New chunks encoded as one text.
PACK = 2000
#: Texts are taken up so many rows at a time and handled in groups of about so many code points.
ROWS, GROUP = 500, 1_000_000

#: White space next to a space, or a space at the end: there a text can't be cut at its spaces.
BESIDE = re.compile(r"\s | \s| \Z").search


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last token of each group on both sides. ``a`` and ``b``: rising end offsets with the same last one."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    ends_a, ends_b, bytes_a, bytes_b = x.tolist(), y.tolist(), x.tobytes(), y.tobytes()
    starts, runs, shifts = [], [], []
    i = j = 0
    n = len(ends_a)
    while i < n:
        p, q = ends_a[i], ends_b[j]
        while p != q:  # an irregular group: up to the next common end
            if p < q:
                i += 1
                p = ends_a[i]
            else:
                j += 1
                q = ends_b[j]
        # From here on the diagonal: stretches that double as long as the ends agree, then halve; all in bytes, eight an offset.
        at, to, step = 8 * i + 8, 8 * j + 8, 8
        while at + step <= 8 * n and bytes_a[at : at + step] == bytes_b[to : to + step]:
            at, to, step = at + step, to + step, 2 * step
        while step > 8:  # less than a step is left of the stretch
            step >>= 1
            if at + step <= 8 * n and bytes_a[at : at + step] == bytes_b[to : to + step]:
                at, to = at + step, to + step
        starts.append(i)
        runs.append((at >> 3) - i)
        shifts.append(j - i)
        i, j = at >> 3, to >> 3
    lengths = np.array(runs, np.int64)
    left = np.repeat(np.array(starts, np.int64) - lengths.cumsum() + lengths, lengths) + np.arange(lengths.sum())
    return left, left + np.repeat(np.array(shifts, np.int64), lengths)


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Two:
    """Both tokenizers, the bytes of their tokens, and the ids of chunks met before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are Spark's to deal out
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        ids = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.text_a = ids(len(self.bytes_a), ","), ids(len(self.bytes_a), "|")
        self.text_b = ids(len(self.bytes_b), ","), ids(len(self.bytes_b), ";")
        self.chunks: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}
        self.inexact: set[str] = set()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space+text by A and by B."""
        (a,) = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)
        return np.array(a.ids, "<u4"), np.array(self.b.encode([text], num_threads=1)[0], "<u4")

    def exact(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Both sides' bytes are those of space+text."""
        want = f" {text}".encode()
        return all(b"".join(map(table.__getitem__, x.tolist())) == want for table, x in ((self.bytes_a, a), (self.bytes_b, b)))

    def aligned(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> list[tuple[str, bytes]]:
        """Groups as text and linked pairs, cut at the byte offsets ``ends``, where tokens of both sides end. Before its pairs a
        stretch has its numbers of tokens, as a negative integer."""
        end_a, end_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        left, right = cuts(end_a, end_b)
        # "a,a|b,b;": tokens of A come after the tokens of B of all groups before theirs, those of B after A's of their own group.
        out = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], right[:-1] + 1]), np.diff(left, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(left + 1, np.diff(right, prepend=-1))
        out[at_a], out[at_b] = self.text_a[0][a], self.text_b[0][b]
        out[at_a[left]], out[at_b[right]] = self.text_a[1][a[left]], self.text_b[1][b[right]]
        last = np.searchsorted(end_a[left], ends)  # the last group of each stretch
        out[at_b[right[last]]] += "\n"
        pairs = b[right].astype(np.int64) << 32 | a[left]
        sizes = -1 - (np.diff(right[last], prepend=-1) << 32 | np.diff(left[last], prepend=-1))
        first = np.concatenate([[0], last[:-1] + 1])
        raw, at = np.insert(pairs, first, sizes).tobytes(), (8 * (first + np.arange(len(first)))).tolist()
        return list(zip("".join(out.tolist()).split("\n"), (raw[p:q] for p, q in zip(at, [*at[1:], len(raw)], strict=True)), strict=False))

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks as one text of chunks and spaces; each by itself where a side changes bytes."""
        for lo in range(0, len(chunks), PACK):
            some = chunks[lo : lo + PACK]
            text = " ".join(some)
            a, b = self.ids(text)
            if self.exact(text, a, b):
                ends = np.array([len(c.encode()) + 1 for c in some]).cumsum()
                self.chunks.update(zip(some, self.aligned(a, b, ends), strict=True))
            elif len(some) == 1:
                self.inexact.add(text)
                self.chunks[text] = "", b""
            else:
                self.learn(some[: len(some) // 2])
                self.learn(some[len(some) // 2 :])

    def align(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, tuple[int, int]]]:
        """Per text, its groups, linked pairs and numbers of tokens; nothing where bytes differ. Neither tokenizer has a token with a
        space after its first character, unless white space is beside that space, so tokens of both end before it: any
        other text is cut at its spaces, and each distinct chunk is encoded and aligned once."""
        if len(self.chunks) > CHUNKS:
            self.old, self.chunks = self.chunks, {}
            self.inexact.intersection_update(self.old)
        parts = [[] if BESIDE(f" {t}") else t.split(" ") for t in texts]
        ask = set().union(*parts).difference(self.chunks)
        for c in [c for c in ask if c in self.old]:
            self.chunks[c] = self.old[c]
            ask.discard(c)
        self.learn([*ask])
        for t, p in zip(texts, parts, strict=True):
            if p and self.inexact.isdisjoint(p):
                found = [*map(self.chunks.__getitem__, p)]
            elif self.exact(t, *(ids := self.ids(t))):
                found = self.aligned(*ids, np.array([len(t.encode()) + 1]))
            else:
                found = []
            flat = np.frombuffer(b"".join([x[1] for x in found]), "<i8")
            sizes = -1 - flat[flat < 0]
            yield "".join([x[0] for x in found])[:-1], flat[flat >= 0], (int((sizes & 0xFFFFFFFF).sum()), int((sizes >> 32).sum()))


#: Tokenizers and chunks that outlive a task in its worker: those of the last paths.
_kept: dict[tuple[str, str], Two] = {}


def kept_two(paths: tuple[str, str]) -> Two:
    if paths not in _kept:
        _kept.clear()
        _kept[paths] = Two(*paths)
    return _kept[paths]


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about GROUP code points."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= GROUP or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def linked(docs: DataFrame, locate: Callable[[], tuple[str, str]], key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (distinct linked id pairs, B's id in
    the upper 32 bits, and how often each is linked); with_groups: the groups as text as well. ``locate`` gives the
    paths of A and B on the executor that asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = kept_two(locate())
        nothing = np.zeros(0, np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in groups_of(texts):
                rows = []
                found = two.align([t for t in texts[lo:hi] if t])
                for t in texts[lo:hi]:
                    said, links, (n_a, n_b) = next(found) if t else ("", nothing, (0, 0))
                    pairs, times = np.unique(links, return_counts=True)
                    rows.append((n_a, n_b, len(links), len(links), hashlib.sha256(said.encode()).hexdigest() if said else "", pairs, times, said))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()),
                        pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.int32())), *([pa.array(columns[7], pa.string())] if with_groups else []),
                    ],
                    names=names,
                )

    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])]
    kinds = ["long", docs.schema[key].dataType.simpleString(), *["long"] * 4, "string", "array<long>", "array<int>", "string"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False)))


def pair_counts(links: DataFrame) -> DataFrame:
    """Per linked id pair: pair, c (links of the corpus that hold it), best (c is the highest of its B id)."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("c"))
    # A B id has no more rows here than A has ids.
    highest = F.max("c").over(Window.partitionBy(F.shiftright("pair", 32)))
    return each.withColumn("best", F.col("c") == highest)


def scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``links`` with n_best and count_sum instead of their pairs. Both tables are read several times: have them stored."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    heavy = counts.filter(F.col("c") * HEAVY > total).orderBy("pair").collect()  # fewer than HEAVY rows: their shares add up to 1 at most
    keys, sizes, best = (np.array([r[n] for r in heavy], np.int64) for n in ("pair", "c", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            starts = np.concatenate([[0], pairs.value_lengths().to_numpy(zero_copy_only=False).cumsum()]).astype(np.int64)
            flat, n = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            add = lambda x: np.diff(np.concatenate([[0], x.cumsum()])[starts])
            hit, sums = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
            hit[known], sums[known] = (n * best[at])[known] if len(keys) else 0, (n * sizes[at])[known] if len(keys) else 0
            left = pa.array(np.concatenate([[0], (~known).cumsum()])[starts], pa.int32())
            light = [pa.ListArray.from_arrays(left, pa.array(x[~known], kind)) for x, kind in ((flat, pa.int64()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(add(hit)), pa.array(add(sums)), *light], names=[*kept, "hits", "sums", "pairs", "times"])

    kept = [c for c in links.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in kept)
    known = links.mapInArrow(run, f"{schema}, hits long, sums long, pairs array<long>, times array<int>")
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    light = counts.filter(F.col("c") * HEAVY <= total)
    more = rare.join(light, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("hits_"), F.sum(F.col("n") * F.col("c")).alias("sums_"))
    total_of = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return known.join(more, "row", "left").select(*kept, total_of("hits", "hits_").alias("n_best"), total_of("sums", "sums_").alias("count_sum"))


def aligned(docs: DataFrame, locate: Callable[[], tuple[str, str]], key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups: the groups as text."""
    links = stored(linked(docs, locate, key, text, with_groups), "links")
    counts = stored(pair_counts(links), "pair_counts")
    said = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return scored(links, counts).select(F.col("key").alias(key), *said)


def public_pair() -> tuple[str, str]:
    """The public 50k byte-level vocabulary and the 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
