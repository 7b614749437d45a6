"""Vector codes, token alignment and personal data against plain Python, and their defined results on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslink.llm import alignment, pii, vector_codes
from corpuslink.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_cover_tree_assigns_as_all_distances_do():
    rng = np.random.default_rng(1)
    for n, low, high in ((300, -500, 500), (2048, -500, 500), (1, 0, 9), (50, -3, 3), (1000, 0, 2)):
        points = rng.integers(low, high, (n, 16))
        points[: n // 3] = points[0]
        tree = vector_codes.CoverTree.build(points)
        assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
        book = points[rng.integers(0, n, 64)].copy()
        book[5] = book[3]
        got = tree.assigned(book)
        assert (got == ((tree.points[:, None] - book[None]) ** 2).sum(-1).argmin(1)).all()
        count, total = tree.sums(got, 64)
        want = np.zeros((64, 16), int)
        np.add.at(want, got, tree.points)
        assert (want == total).all() and (np.bincount(got, minlength=64) == count).all()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((k, [int(np.floor(1024 * float(x))) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    v = np.array([x[1] for x in kept])
    code, error, books = [], np.zeros(len(kept), int), []
    for p in np.split(v, parts, axis=1):
        book = p[:entries].copy()
        nearest = lambda: ((p[:, None] - book[None]) ** 2).sum(-1)  # noqa: B023, E731
        for _ in range(rounds):
            a = nearest().argmin(1)
            for e in set(a.tolist()):
                book[e] = p[a == e].sum(0) // (a == e).sum()
        d = nearest()
        code.append(d.argmin(1))
        error += d.min(1)
        books.append(book)
    labels = Counter()
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        labels[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return {k: ("".join(f"{c[i]:02x}" for c in code), int(error[i]), labels[lab], sha) for i, (k, _, lab) in enumerate(kept)}, books


def test_vector_codes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows += [(10_000, None, 1), (10_001, [None] + [0.5] * 63, 1), (10_002, [float("nan")] * 64, 1), (10_003, [float("inf")] * 64, None), (10_004, [0.0] * 64, None), (10_005, rows[7][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    want, books = plain_codes(rows)
    found = vector_codes.compressed(df)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()}
    assert got == want
    back = vector_codes.decoded(found, books).filter("vec_id = 10005").first()["vector"]
    assert sum((int(np.floor(1024 * a)) - 1024 * b) ** 2 for a, b in zip(rows[7][1], back, strict=True)) == want[10_005][1]
    assert vector_codes.compressed(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int"))


def test_vector_codes_of_few_rows(spark):
    rows = [(3, [0.25] * 8, None), (1, [-0.5] * 8, 2), (1, [-0.5] * 8, 2), (2, [1.0] * 8, None)]
    got = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(1, "00000000", 0), (1, "00000000", 0), (2, "02020202", 0), (3, "03030303", 0)]


def test_cuts_are_the_common_ends():
    rng = random.Random(3)
    for _ in range(3000):
        m, d = rng.randint(1, 80), rng.choice([0.1, 0.5, 0.9, 0.97])
        a = {x for x in range(1, m) if rng.random() < d} | {m}
        b = {x for x in range(1, m) if rng.random() < d or (x in a and rng.random() < 0.8)} | {m}
        left, right = alignment.cuts(np.array(sorted(a)), np.array(sorted(b)))
        assert [sorted(a)[i] for i in left] == [sorted(b)[j] for j in right] == sorted(a & b)


class Plain:
    """Alignment of one text by the two libraries alone."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        path_a, path_b = alignment.public_pair()
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        table = {c: bytes([b]) for c, b in alignment.byte_alphabet().items()}
        self.of_a = {i: b"".join(table[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in table for c in t)}

    def of_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return 0, 0, "", []
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.of_a[i] for i in a], [self.of_b(i) for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            return 0, 0, "", []
        ends_a, ends_b = ({e: k + 1 for k, e in enumerate(itertools.accumulate(map(len, x)))} for x in (bytes_a, bytes_b))
        said, links, p, q = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[e], ends_b[e]
            said.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        return len(a), len(b), ";".join(said), links


ODD = [
    None, "", "a", "a b", " a", "a ", "a  b", "\na", "é à 😀 [INST] </s>", "<|endoftext|> <s> a</s>", "▁x y", "a▁ b c", "a b c", "ﬁ ½", "don't 's", "　x", "x\x00y z", "¨ ̈a", "<0x0A> z",
    "a\tb \tc", "Ａ b", "​x y", "the " * 5000 + "end", "x" * 20_000, "a b",
]


def test_alignment(spark):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(150).collect()]
    rows = [(i % 170, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("pairs", F.lit(1)).repartition(3)
    plain = Plain()
    want = [(k, *plain(t)) for k, t in rows]
    counts = Counter(x for w in want for x in w[4])
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    want = sorted((k, a, b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha(s)) for k, a, b, s, x in want)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[n] for n in names) for r in alignment.aligned(df, alignment.public_pair).collect()) == want
    few = alignment.aligned(df.limit(20), alignment.public_pair, with_groups=True).collect()
    assert all(sha(r["groups"]) == r["groups_sha256"] for r in few)
    assert alignment.aligned(df.limit(0), alignment.public_pair).count() == 0


def test_frequent_and_rare_pairs_count_alike(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["doc_id", "n_best", "count_sum"]
    every = []
    for heavy in (1, 50, 10**9):
        monkeypatch.setattr(alignment, "HEAVY", heavy)
        every.append(sorted(tuple(r[n] for n in names) for r in alignment.aligned(df, alignment.public_pair).collect()))
    assert every[0] == every[1] == every[2]


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    bare = lambda s: re.sub("[^0-9]", "", s)

    def check(s):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(bare(s)))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    tests = {
        "email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (CARD, lambda s: 16 <= len(bare(s)) <= 19 and check(s)), "phone": (PHONE, lambda s: 8 <= len(bare(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text or "") if ok(m[0])]


PRIVATE = [
    None, "", "a@b.c_d@e.f x@y.z.@q.r", "@a.b a@b a@b.", "1.2.3.4.5.6.7.8 300.1.1.1 00001.02.003.255 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111111111",
    "+1 (743) 555-3824 ++4912345678 +1          +123456789012345678", "😀 mail: ä.b@c.de 😀 +49 30 1234567", "+1.2.3.4 5 a@1.2.3.4", "call me at (555) 123-4567 tomorrow",
    "contact: jane at example dot com or jane (at) example (dot) org", "signed, Dr Anna Schmidt", "ip fe80:0:0:0:1:2:3:4 seen", "visa 378282246310005 ok", "x" * 4000, "1" * 4000,
    "a@b" + ".c" * 20_000, "1.1.1.1 " * 300, "a" * 3000 + "@" + "b" * 3000,
]


def test_personal_data_base_spans(spark):
    texts = PRIVATE + [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").filter("text rlike '@|[+]|[0-9]{3}'").limit(1500).collect()]
    df = spark.createDataFrame([(i % 1400, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("c", F.lit(1)).repartition(4)
    got = pii.digested(pii.detected(df)).collect()
    want = []
    for i, t in enumerate(texts):
        found = plain_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        n = Counter(k for k, _, _ in found)
        want.append((i % 1400, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(tuple(r[k] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in got) == sorted(want)
    spans = {(r["doc_id"], *s.split(":")) for r in got for s in r["spans"].split(",") if s}
    assert all((i % 1400, k, str(a), str(b)) in spans for i, t in enumerate(texts) for k, a, b in plain_spans(t))
    assert pii.detected(df.limit(0)).count() == 0
    nothing = pii.digested(pii.detected(spark.createDataFrame([(1, "plain words"), (None, None)], "doc_id long, text string"))).collect()
    assert [(r["spans"], r["n_added"]) for r in nothing] == [("", 0), ("", 0)]


def test_personal_data_adds_what_the_labelers_favour(spark):
    """Base spans train the classifier; it adds spans of other forms in the right context and leaves look-alikes."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(4000).collect()]
    yes = {
        -1: "please call (555) 123-4567 today", -2: "contact jane at example dot com today", -3: "my credit card 378282246310005 was lost", -4: "signed by Dr Anna Schmidt in Berlin",
        -5: "the server fe80:0:0:0:1:2:3:4 is down",
    }
    no = {-6: "order 1234567812345678 is late", -7: "Seen By Many People", -8: "look at the dot on the page", -9: "version 555-123-45 of 2024-01-15"}
    df = spark.createDataFrame([tuple(r) for r in docs] + [*yes.items(), *no.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.detected(df).collect()}
    assert [k for k in yes if not got[k]["spans"]] == []
    assert [k for k in no if got[k]["spans"]] == []
    clean = [r["doc_id"] for r in docs if not plain_spans(r["text"]) and not re.search(r"[0-9]{13}", r["text"] or "")]
    assert sum(len(got[k]["spans"]) for k in clean) <= len(clean) // 200


def test_personal_data_main_path_is_native(spark):
    plan = QUERIES["op13_personal_data"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_expectation_maximisation_finds_the_reliable_labeler(spark):
    """Three labelers agree with the hidden truth at known rates; the estimates order them."""
    rng, rows = np.random.default_rng(5), []
    for _ in range(4000):
        y = rng.random() < 0.4
        rows.append((0, [2 if (rng.random() < p) == y else 0 for p in (0.95, 0.9, 0.7)] + [1, 1], bool(y)))
    df = spark.createDataFrame(rows, "kind int, votes array<int>, y boolean")
    known = pii.estimated(df.groupBy("kind", "votes").agg(F.count("*").alias("n"))).collect()
    found = {tuple(r["votes"]): r["posterior"] for r in known}
    right = np.mean([(found[tuple(v)] >= 0.5) == y for _, v, y in rows])
    assert right > 0.94
    assert found[(2, 0, 0, 1, 1)] > found[(0, 2, 0, 1, 1)] > found[(0, 0, 2, 1, 1)]


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    from corpuslink.llm import ann

    base = spark.read.parquet(f"{DATA}/embeddings.parquet")
    asked = base.filter("vec_id % 10 = 0")
    want = sorted(map(tuple, ann.search(base, asked, k=5).collect()))
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    assert sorted(map(tuple, ann.search(base, asked, k=5).collect())) == want
