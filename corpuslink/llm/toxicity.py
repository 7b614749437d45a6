"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (words and word beginnings that mostly toxic texts hold),
lexicon words near second-person words, capitals, punctuation and obfuscation rates, lengths. The lexicon, the trees
and the calibration are fitted by Spark ML on at most ``SAMPLE`` labelled rows, chosen by the hash of their id; one in
four of them is kept from the trees for the calibration. Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts are scored from their (zero) features; repeated rows are scored one by one; without
labelled rows, or with labels of one class only, every score is the share of that class (0 without rows). Labels of 0.5 and more are toxic, null ones
no labels. If the calibration part lacks a class, scores are the trees' own probabilities; if the trees' part lacks one, all labelled rows train the
trees. Ids may be of any type; repeated labels of an id count as rows of their own. An empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE, LEXICON, LEAST_DOCS, PRECISION, BEGINNINGS, CALIBRATION = 12_000, 400, 4, 0.6, (4, 5, 6, 7), 4
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta usted tú ti su".split())
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c in b"@$*" else 32 for c in range(256))
_DIGITS = b"0123456789@$*"
FEATURES = ["n_words", "lexicon", "lexicon_rate", "lexicon_kinds", "near_second", "second_rate", "capital_rate", "exclaim_rate", "question_rate", "punctuation_rate", "obfuscated_rate"]


def features(text: str | None, lexicon: "Lexicon") -> list[float]:
    raw = (text or "").encode()
    words = raw.translate(_PLAIN).split()
    n = max(1, len(words))
    hits = lexicon.hits(words)
    near = sum(not SECOND.isdisjoint(words[max(0, i - 5) : i + 6]) for i in hits)
    letters = max(1, len(raw) - len(raw.translate(None, _LETTERS)))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    mixed = 0
    if len(raw) != len(raw.translate(None, _DIGITS)):
        mixed = sum(w.translate(None, _DIGITS).isalpha() and len(w.translate(None, _DIGITS)) < len(w) for w in words)
    marks = raw.count(b"!"), raw.count(b"?")
    other = sum(raw.count(c) for c in (b".", b",", b";", b":", b"#", b"%", b"&"))
    return [
        float(len(words)), float(len(hits)), len(hits) / n, float(len({words[i] for i in hits})), float(near),
        sum(map(SECOND.__contains__, words)) / n, capitals / letters, marks[0] / n, marks[1] / n, other / n, mixed / n,
    ]


def featured(docs: DataFrame, lexicon: frozenset[bytes], key: str, text: str, more: str = "") -> DataFrame:
    """key, ``more`` (a column to carry), and one double column for each feature."""
    carried = [key, *([more] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for batch in batches:
            rows = [features(t.as_py(), known) for t in batch.column(0)]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*carried, *FEATURES])

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(text, *carried).mapInArrow(run, head + "".join(f", {f} double" for f in FEATURES))


def sampled(labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, by the hash of the id: every part of the table alike."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), (F.col(label) >= 0.5).cast("double").alias("_y"))
    total = max(1, known.count())
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1_000_000))
    few = known.filter(unit < int(1_000_000 * min(1.0, 1.1 * sample / total)) + 1)
    return few.orderBy(unit, "id").limit(sample)


def learn_lexicon(rows: DataFrame, text: str) -> frozenset[bytes]:
    """Words and word beginnings (with ``*``) that mostly toxic texts among the sampled rows (text, _y) hold; at most LEXICON."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}@$*]+")), lambda w: F.length(w).between(2, 40))
    terms = F.flatten(
        F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in BEGINNINGS]))
    )
    held = rows.select("_y", F.explode(F.array_distinct(F.array_compact(terms))).alias("term"))
    sums = held.groupBy("term").agg(F.sum("_y").alias("bad"), F.count("*").alias("n"))
    share = (F.col("bad") + 0.1) / (F.col("n") + 1.0)
    best = sums.filter((F.col("bad") >= LEAST_DOCS) & (share > PRECISION))
    return frozenset(r["term"].encode() for r in best.orderBy(F.desc(share * F.sqrt("bad")), "term").limit(LEXICON).collect())


class Lexicon:
    """Terms as sets of bytes; ``heads`` are the first three bytes of all, which most words don't have."""

    def __init__(self, terms: frozenset[bytes]):
        self.words = frozenset(t for t in terms if not t.endswith(b"*"))
        self.starts = frozenset(t[:-1] for t in terms if t.endswith(b"*"))
        self.sizes = sorted({len(t) for t in self.starts})
        self.heads = frozenset(t[:3] for t in self.words | self.starts)

    def hits(self, words: list[bytes]) -> list[int]:
        heads = self.heads
        near = [i for i, w in enumerate(words) if w[:3] in heads]
        return [i for i in near if words[i] in self.words or any(words[i][:k] in self.starts for k in self.sizes)]


def score(docs: DataFrame, labels: DataFrame, learn_from, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: key and score. ``learn_from``: Column on ``labels`` that says which may be learned from."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    chosen = stored(sampled(labels.filter(learn_from), key, label, sample), "chosen")  # at most `sample` rows of two numbers
    rows = stored(docs.join(F.broadcast(chosen), "id"), "labelled")
    turn = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id")), F.lit(CALIBRATION)) == 0
    held = {(r["held"], r["_y"]) for r in rows.groupBy(turn.alias("held"), "_y").count().collect()}  # four rows at most
    classes = {y for _, y in held}
    if len(classes) < 2:
        return docs.select(F.col("id").alias(key), F.lit(next(iter(classes), 0.0)).alias("score"))
    lexicon = learn_lexicon(rows, "body")
    table = VectorAssembler(inputCols=FEATURES, outputCol="x")
    known = stored(featured(rows, lexicon, "id", "body", "_y"), "features")
    apart = len({y for part, y in held if not part}) == 2
    trees = GBTClassifier(featuresCol="x", labelCol="_y", maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=8, seed=7)
    model = trees.fit(table.transform(known.filter(~turn) if apart else known))
    raw = vector_to_array("probability")[1].alias("raw")
    scored = model.transform(table.transform(featured(docs, lexicon, "id", "body"))).select(F.col("id").alias(key), raw)
    if not apart or len({y for part, y in held if part}) < 2:
        return scored.withColumnRenamed("raw", "score")
    part = model.transform(table.transform(known.filter(turn))).select("_y", raw)
    calibrated = IsotonicRegression(featuresCol="raw", labelCol="_y").fit(part)
    # A hundredth of the raw probability orders the ties that a step function leaves.
    value = 0.99 * F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)) + 0.01 * F.col("raw")
    return calibrated.transform(scored).select(key, value.alias("score"))
