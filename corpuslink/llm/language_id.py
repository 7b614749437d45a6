"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier per bit, over hashed byte n-grams (1 to 3) of the text, predicts
that bit. Decoding takes the codeword of least loss-weighted distance: a wrong bit costs its logistic loss times the bit's
accuracy on rows kept from the fit. Texts whose two nearest codewords are almost as near are flagged as ambiguous.

Fitted on at most ``PER_LANGUAGE`` labelled rows of each language and ``ROWS`` in all (one of each, if there are more languages), chosen by
the hash of their id; their n-gram vectors, ``ROWS`` times 8 KB, are gathered by the driver. Every language that has a row is learned. Scoring is one pass
over whole texts without a shuffle. Defined results: ``und`` with score 0 if the text is null or has no letters, or if nothing could be learned;
with one language, it is predicted with score 1; repeated rows are predicted one by one; ids may be of any type; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PER_LANGUAGE, ROWS, BITS, SLOTS, AMBIGUOUS = 400, 8192, 15, 4096, 0.1
_LETTER = regex.compile(r"\p{L}").search
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 64 and c != 39 else c for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed counts of byte 1- to 3-grams, square roots, scaled to length 1."""
    b = np.frombuffer(text.encode().translate(_FOLD), np.uint8).astype(np.uint32)
    one = (b * np.uint32(2654435761)) >> np.uint32(20)
    x = np.bincount(one, minlength=SLOTS)
    if len(b) > 1:
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1)
        x = x + np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=SLOTS)
        if len(b) > 2:
            three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(7)
            x = x + np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=SLOTS)
    v = np.sqrt(x.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def codewords(n: int, bits: int = BITS, tries: int = 400) -> np.ndarray:
    """n codewords of +1 and -1; no bit is the same for all.

    Up to five languages: every split into two sides. More: of ``tries`` pseudo-random codes (fewer for very many languages) the one whose
    nearest two codewords are farthest apart.
    """
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits).T if splits else np.ones((n, 1), int)
    rng = np.random.default_rng(12)
    best, least = None, -1
    for _ in range(max(3, min(tries, tries * 2**12 // n**2))):
        code = rng.choice([-1, 1], (n, max(bits, 4 * int(np.ceil(np.log2(n))))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        agree = code @ code.T - 2 * code.shape[1] * np.eye(n, dtype=int)
        apart = (code.shape[1] - agree.max()) // 2
        if apart > least:
            best, least = code, apart
    return best


def fit(x: np.ndarray, names: list[str]) -> dict | None:
    """Classifiers of the bits on a bounded sample: logistic regression by accelerated gradient steps."""
    languages = sorted(set(names))
    if not languages:
        return None
    code = codewords(len(languages))
    y = code[[languages.index(n) for n in names]].astype(np.float32)
    fold = np.arange(len(x)) % 5 == 0

    def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = v = np.zeros((SLOTS, code.shape[1]), np.float32)
        for step in range(150):
            margin = y * (x @ v)
            gradient = -x.T @ (y / (1 + np.exp(np.clip(margin, -30, 30)))) / len(x) + 1e-5 * v
            new = v - 4.0 * gradient
            v = new + (step / (step + 3)) * (new - w)
            w = new
        return w

    trial = solve(x[~fold], y[~fold]) if (~fold).any() else np.zeros((SLOTS, code.shape[1]), np.float32)
    weight = np.maximum(((x[fold] @ trial) * y[fold] > 0).mean(axis=0), 0.05).astype(np.float32)
    return {"languages": languages, "code": code.astype(np.float32), "w": solve(x, y), "weight": weight}


def decode(model: dict, margins: np.ndarray) -> tuple[str, float, bool]:
    """Nearest codeword, its share in (0, 1], and whether the second is almost as near."""
    loss = (np.logaddexp(0, -model["code"] * margins[None, :]) * model["weight"]).sum(axis=1)
    p = np.exp(loss.min() - loss)
    p = p / p.sum()
    order = np.argsort(-p, kind="stable")
    near = len(p) > 1 and p[order[0]] - p[order[1]] < AMBIGUOUS
    return model["languages"][order[0]], float(p[order[0]]), bool(near)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = [grams(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(g, pa.binary())], names=["name", "g"])


def learn(docs: DataFrame, learn_from, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> dict | None:
    """Fit on at most ``per_language`` rows of each language."""
    unit = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(10_000_000))
    known = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("name"), unit.alias("unit"), F.col(text).alias("body"))
    counts = stored(known.groupBy("name").count(), "languages")  # a row a language
    if not (total := counts.count()):
        return None
    # A share of each language that holds its rows of least hash, then their exact number.
    below = counts.select("name", F.least(F.lit(10_000_000), (F.lit(10_000_000 * 1.5 * per_language) / F.col("count")).cast("long") + 1).alias("below"))
    few = stored(known.join(below, "name").filter("unit < below").drop("below"), "language")
    per_language = max(1, min(per_language, ROWS // total))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("unit", "body"))
    rows = few.withColumn("r", rank).filter(F.col("r") <= per_language).select("body", "name").mapInArrow(_gram_rows, "name string, g binary").collect()
    rows.sort(key=lambda r: (r["name"], bytes(r["g"])))  # the order in which rows arrive must not matter
    x = np.frombuffer(b"".join(r["g"] for r in rows), np.float16).reshape(len(rows), SLOTS).astype(np.float32)
    return fit(x, [r["name"] for r in rows])


def identify(docs: DataFrame, learn_from, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row: key, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, learn_from, key, text, lang, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                rows.append(decode(model, grams(t) @ model["w"]) if model and t and _LETTER(t) else ("und", 0.0, False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows])],
                names=[key, "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean")
