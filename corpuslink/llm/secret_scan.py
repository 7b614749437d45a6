"""Secret scans: three base patterns, and password guess costs for values in a credential context.

The cost of a value is the least product of guesses over all its segmentations into dictionary
words, dates, repeats, keyboard walks and brute-force spans (dynamic programming over its
positions, log10). Values whose cost reaches ``MIN_LOG10`` are likely real secrets and add a
``guess`` span, also where it goes on after a base span; base spans always stay. Prose after a context is no secret because its words, or
their parts, are in the dictionary; letters that are no words cost what brute force costs, in one case or in two.

The dictionary is the list of common password words and word parts, then the ``DICTIONARY`` commonest words of all texts (of 4 to ``LONGEST`` letters), counted by
Spark; these are all that the driver gathers and sends out. Then one pass over the rows. One programme runs over a value of any length, and
every segment is tried at its full length: words, dates, walks, runs, and blocks said twice, of any size. It ends as soon as every
way on costs MIN_LOG10, which random values reach within some twenty code points; one that stays cheap takes time that grows with its square.

Defined results: null text counts as empty and has no spans; repeated rows are scanned one by one; whole texts are scanned, however long; ids may be
of any type; an empty table gives an empty table; other columns are ignored by ``scan`` and kept by ``redacted``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Fixed patterns of the base rule; ASCII letters only in either case.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further credential contexts, whose values are kept only when they are costly to guess.
CONTEXT = re.compile(
    r"""(?i:(?:(?:password|passwd|secret|token|(?:api|secret)[_\x20-]?key)["']?\x20*(?:[:=]|\x20is\x20)|(?:pwd|passphrase|passcode|credentials?|auth|bearer|private_?key|access_?key|client_?id|signature|session_?id|cookie)["']?\x20*(?:[:=]|\x20is\x20|\x20)))\x20*["']?([^\x00-\x20"'<>,;]{8,})""",
    re.ASCII,
)
HINTS = ("passw", "secret", "token", "key")
CONTEXT_HINTS = ("passw", "secret", "token", "pwd", "passphrase", "passcode", "credential", "auth", "bearer", "key", "client", "signature", "session", "cookie")
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 12.0
DICTIONARY, LEAST_COUNT, LONGEST, CACHE = 20_000, 5, 64, 20_000

#: Common words inside passwords, by falling frequency, and common parts of longer words.
WORDS = (
    "password love admin welcome monkey dragon master login princess sunshine shadow letmein football baseball superman "
    "michael secret summer winter spring autumn hello freedom whatever trust ninja azerty starwars computer internet "
    "test user guest root default change private public server database system token access the and for you that with this "
    "tion ation ication ment ness able ible ical ally ious ence ance ing ized ship ful less inter under over trans counter self auth ident inform commun organ "
    "govern develop manage require process connect certif operat"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("0134578@$!", "oleastbasi")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(r[i], r[i + d]) for r in ROWS for d in (1, -1) for i in range(len(r)) if 0 <= i + d < len(r)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?")


def _alphabet(value: str) -> int:
    return sum(
        size
        for pattern, size in (("[a-z]", 26), ("[A-Z]", 26), (r"\d", 10), (r"[^A-Za-z0-9]", 33))
        if re.search(pattern, value)
    ) or 1


def lengths_of(ranks: dict[str, int]) -> tuple[int, ...]:
    """The lengths of dictionary words, from three letters on."""
    return tuple(sorted({len(w) for w in ranks if len(w) >= 3}))


def guess_cost(value: str, ranks: dict[str, int] = RANK, enough: float = math.inf, lengths: tuple[int, ...] | None = None) -> float:
    """log10 of the least guesses over all segmentations of ``value``; where they reach ``enough``, something not below it."""
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a letter that has no single lower-case code point
        lower = value
    lengths = lengths_of(ranks) if lengths is None else lengths
    plain, step, twice = lower.translate(LEET), math.log10(_alphabet(value)), math.log10(2.0)
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    same = np.zeros(n // 2 + 2, np.int64)  # of each block size, how far back every code point equals the one a block before
    block = np.arange(len(same))
    walk = run = 1  # lengths of the keyboard walk and of the run that end here
    longest = lengths[-1] if lengths else 0
    for j in range(1, n + 1):
        cost = best[j - 1] + step
        for size in lengths:
            if size > j:
                break
            i = j - size
            if rank := ranks.get(lower[i:j]):
                cost = min(cost, best[i] + math.log10(rank + 10) + (0.0 if value[i:j] == lower[i:j] else math.log10(2.0 + size)))
            elif rank := ranks.get(plain[i:j]):
                cost = min(cost, best[i] + math.log10(rank + 10) + math.log10(4.0 + size))
        for size in (4, 6, 7, 8, 10):
            if size <= j and DATE.fullmatch(value, j - size, j):
                cost = min(cost, best[j - size] + (2.1 if size == 4 else 4.6))
        if j > 1:
            walk = walk + 1 if (lower[j - 2], lower[j - 1]) in NEXT else 1
            run = run + 1 if value[j - 2] == value[j - 1] else 1
        if walk >= 3:
            cost = min(cost, best[j - walk] + math.log10(40.0 * walk))
        if run >= 3:
            cost = min(cost, best[j - run] + step + math.log10(run))
        most = min(len(same), j) - 1
        if most >= 2:
            equal = points[j - 1 - most : j - 1][::-1] == points[j - 1]
            same[1 : most + 1] = np.where(equal, same[1 : most + 1] + 1, 0)
            said = np.flatnonzero(same[2 : most + 1] >= block[2 : most + 1]) + 2  # blocks said twice
            if len(said):
                cost = min(cost, best[j - said].min() + twice)
        best[j] = cost
        # No later segment begins before these places.
        if cost >= enough and best[max(0, min((j + 1) // 2, j + 1 - longest, j - walk, j - run)) : j + 1].min() >= enough:
            return float(cost)
    return float(best[n])


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY, least: int = LEAST_COUNT) -> dict[str, int]:
    """Word to rank: the password words, then the ``size`` commonest words of four to LONGEST letters that all texts hold ``least`` times or more."""
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).filter(F.length("w").between(4, LONGEST))
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "words")
    # Only words from the power of two up at which there are enough are sorted and sent, whatever the number of partitions.
    level, sums, low = F.floor(F.log2("n")).cast("int"), 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # 64 rows at most
        low, sums = r["level"], sums + r["words"]
        if sums >= size:
            break
    common = [r["w"] for r in counts.filter(level >= low).orderBy(F.desc("n"), "w").limit(size).collect()]
    discard(counts)
    return {w: i + 1 for i, w in reversed(list(enumerate([*WORDS, *common])))}


class Costs(dict):
    """Values met lately, and whether each costs ``least`` or more."""

    def __init__(self, ranks: dict[str, int] = RANK, least: float = MIN_LOG10):
        super().__init__()
        self.ranks, self.least, self.lengths = ranks, least, lengths_of(ranks)

    def __missing__(self, value: str) -> bool:
        if len(self) > CACHE:
            self.clear()
        high = guess_cost(value, self.ranks, self.least, self.lengths) >= self.least
        if len(value) <= 200:
            self[value] = high
        return high


def find(text: str | None, costly: Costs) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans: (start, index of the kind, end), in code points, each list sorted."""
    if not text:
        return [], []
    base: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more: list[tuple[int, int, int]] = []
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            if not any(s <= a and b <= e for s, _, e in base) and costly[m[1]]:
                more.append((a, 3, b))
    return base, more


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span, overlapping ones merged, replaced by ``[SECRET]``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", min_log10: float = MIN_LOG10) -> DataFrame:
    """Per row: key, counts of the base kinds, digest of the base spans, all spans, and the number of added ones."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text))  # DICTIONARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costly = Costs(shared.value, min_log10)
        for batch in batches:
            rows = [find(t.as_py(), costly) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(k == n for _, k, _ in b) for b, _ in rows], pa.int64()) for n in range(3)],
                    pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                    pa.array([listed(sorted(b + m)) for b, m in rows], pa.string()),
                    pa.array([len(m) for _, m in rows], pa.int64()),
                ],
                names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars", min_log10: float = MIN_LOG10) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``length``, where present, made to fit."""
    names, schema = docs.columns, docs.schema
    at, size = names.index(text), names.index(length) if length in names else None
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text))  # DICTIONARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costly = Costs(shared.value, min_log10)
        for batch in batches:
            columns = list(batch.columns)
            new = []
            for t in columns[at]:
                base, more = find(t := t.as_py(), costly)
                new.append(redact(t, sorted(base + more)))
            old = columns[at]
            columns[at] = pa.array(new, old.type)
            if size is not None:
                columns[size] = pa.array(
                    [c.as_py() if o.as_py() == t else len(t) for c, o, t in zip(columns[size], old, new, strict=True)], columns[size].type
                )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
