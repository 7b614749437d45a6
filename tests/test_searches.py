"""Searches over rows that repeat, and over many pairs: what is met, and brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslink.functions import text as T
from corpuslink.operators import buckets as B
from corpuslink.operators import documents as D
from corpuslink.operators import jobs as J
from corpuslink.operators import merging as M
from corpuslink.operators import phrases as PH
from corpuslink.operators import positional as PO
from corpuslink.operators import ranking as R
from corpuslink.operators import search as S
from corpuslink.operators.spines import Words

COPIES = 30


def repeated(spark):
    """12 contents, 30 rows each, and 6 texts asked by 20 queries each."""
    words = ["red ring", "old bolt", "small gear", "red bolt"]
    rows = [(c * 1000 + i, words[c % 4], [f"kind {c % 3}", "brand x"], ["part"], 2000 + (i * 7) % 11, (i * 5) % 7, (i * 3) % 10) for c in range(12) for i in range(COPIES)]
    rows = spark.createDataFrame(rows, "id long, question string, tags array<string>, keywords array<string>, year int, copies long, n int")
    asked = [(a * 100 + i, f"{words[a % 4]} kind", f"kind {a % 3}" if a < 5 else "brand") for a in range(6) for i in range(20)]
    return rows, spark.createDataFrame(asked, "query_id long, asked string, topic string")


def met(monkeypatch):
    """The sizes of what ``matching_rows`` meets."""
    sizes, plain = [], R.matching_rows
    monkeypatch.setattr(R, "matching_rows", lambda rows, queries, *a: sizes.append((rows.count(), queries.count())) or plain(rows, queries, *a))
    return sizes


@pytest.mark.parametrize("stop", [None, ["the"]])
def test_official_search_meets_distinct_contents(spark, monkeypatch, stop):
    rows, queries = repeated(spark)
    sizes = met(monkeypatch)
    got = {(r["query_id"], r["place"]): r["id"] for r in J.official_search(rows, queries, 5, stop).collect()}
    assert sizes == [(12, 4)]
    normal = lambda c: T.search_normalise(F.array_join(c, " "))
    toks = T.tokens(T.search_normalise(F.concat_ws(" ", "question", F.array_join("tags", " "), F.array_join("keywords", " "))))
    pairs = rows.withColumn("toks", toks).crossJoin(queries.withColumn("terms", T.tokens(T.search_normalise("asked"))))
    pairs = pairs.filter(F.forall("terms", lambda x: F.exists("toks", lambda y: R.term_hits(x, y))))
    pairs = pairs.withColumn("rank", R.official_rank(F.col("terms"), T.search_normalise("asked"), F.col("toks"), T.search_normalise("question"), normal("tags"), normal("keywords")))
    order = R.relevance_order()
    if stop is not None:
        pairs, order = pairs.withColumn("topic", R.topic_rank(F.col("topic"), F.concat("tags", "keywords"), stop)).filter("topic.score > 0"), R.topic_order()
    want = J.top_per_group(pairs, ["query_id"], order, 5, "place").collect()
    assert got == {(r["query_id"], r["place"]): r["id"] for r in want} and len(got) == 600


def test_workspace_search_meets_distinct_contents(spark, monkeypatch):
    rows, queries = repeated(spark)
    rows = rows.withColumn("path", F.col("tags")).withColumn("more", F.lit("part"))
    sizes = met(monkeypatch)
    got = {(r["query_id"], r["place"]): r["id"] for r in J.workspace_search(rows, queries, 5).collect()}
    assert sizes == [(12, 4)]
    toks = T.tokens(T.search_normalise(F.concat_ws(" ", "question", "more", F.array_join("path", " "))))
    pairs = rows.withColumn("toks", toks).crossJoin(queries.withColumn("terms", T.tokens(T.search_normalise("asked"))))
    pairs = pairs.filter(F.forall("terms", lambda x: F.exists("toks", lambda y: R.term_hits(x, y))))
    pairs = pairs.withColumn("score", R.workspace_score(F.col("terms"), F.col("question"), F.col("path"), F.col("toks")))
    want = J.top_per_group(pairs, ["query_id"], R.workspace_order(), 5, "place").collect()
    assert got == {(r["query_id"], r["place"]): r["id"] for r in want} and len(got) == 600


def test_topic_search_meets_distinct_fields(spark, monkeypatch):
    rows, queries = repeated(spark)
    sizes, plain = [], R.rows_of_contents
    monkeypatch.setattr(R, "rows_of_contents", lambda found, held, *a: sizes.append((held.count(), found.count())) or plain(found, held, *a))
    fields = rows.select("id", F.get("tags", F.lit(0)).alias("tag"), F.get("tags", F.lit(1)).alias("brand"))
    got = {(r["query_id"], r["place"]): r["id"] for r in J.topic_search(fields, queries, ["tag", "brand"], [], 4).collect()}
    assert sizes == [(3, 12)]  # four distinct topics, three distinct fields
    pairs = fields.crossJoin(queries).withColumn("t", R.topic_rank(F.col("topic"), F.array("tag", "brand"), [])).filter("t.score > 0")
    want = J.top_per_group(pairs, ["query_id"], [F.desc("t.phrase"), F.desc("t.every"), F.desc("t.hits"), F.desc(F.round("t.score", 9)), "id"], 4, "place").collect()
    assert got == {(r["query_id"], r["place"]): r["id"] for r in want} and len(got) == 480


def test_document_search_meets_distinct_texts(spark, monkeypatch):
    rows, queries = repeated(spark)
    sizes, plain = [], R.vocabulary_hits
    monkeypatch.setattr(R, "vocabulary_hits", lambda a, b: sizes.append((a.count(), b.count())) or plain(a, b))
    counted, of = [], R.rows_of_contents
    monkeypatch.setattr(R, "rows_of_contents", lambda found, held, *a: counted.append(held.count()) or of(found, held, *a))
    n = F.col("n")
    held = rows.select("id", F.col("question").alias("title"), F.lit("brand x").alias("person"), F.col("tags").alias("concepts"), F.lit("part").alias("rest"), R.document_bonus(n, n % 3, n % 2).alias("bonus"), "n")
    got = {(r["query_id"], r["place"]): (r["id"], round(r["score"], 9)) for r in J.document_search(held, queries, 5).collect()}
    assert counted == [12]
    terms = F.array_distinct(T.terms(T.search_normalise("asked")))
    score = R.document_score(terms, F.col("title"), F.col("person"), F.col("concepts"), F.col("rest"), n, n % 3, n % 2)
    want = J.top_per_group(held.crossJoin(queries).withColumn("score", score), ["query_id"], [F.desc(F.round("score", 9)), "id"], 5, "place").collect()
    assert got == {(r["query_id"], r["place"]): (r["id"], round(r["score"], 9)) for r in want}


def test_best_covers_leave_a_block_without_pairs(spark):
    """The first rows are those of all pairs, and no exchange of the plan carries a pair of a query and a row that isn't among the first of its block."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [(i, " ".join(rng.choices(words + ["filler"] * 4, k=rng.randint(0, 40))) if i % 17 else None, i % 3) for i in range(300)]
    docs = spark.createDataFrame(texts, "id long, text string, e int").withColumn("e", (F.col("id") % 3).cast("int"))
    rows = docs.select("id", "e", PO.positioned_tokens("text", []).alias("p"))
    asked = [(q, rng.sample(words, rng.randint(1, 4))) for q in range(40)] + [(90, []), (91, None), (92, ["alpha", "missing"]), (93, ["beta", None, "", "beta"])]
    asked = spark.createDataFrame(asked, "q long, t array<string>")
    order = [F.desc(F.round("score", 9)), F.desc("e"), "id"]
    every = PO.cover_density_hits(PO.positional_index(rows, "id", "p"), asked, "id", "q", "t").join(docs.select("id", "e").distinct(), "id")
    want = {(r["q"], r["id"], round(r["score"], 9)) for r in J.top_per_group(every, ["q"], order, 7).collect()}
    found = PO.cover_density_best(PO.places(rows, "id", "p", "e"), asked, "id", "q", "t", 7, 3, "e")
    got = [(r["q"], r["id"], round(r["score"], 9)) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 200
    none = PO.cover_density_best(PO.places(rows.limit(0), "id", "p", "e"), asked, "id", "q", "t", 7, 3, "e")
    assert none.count() == 0


def test_vector_hits_of_odd_vectors_equal_all_cosines(spark):
    rng = np.random.default_rng(5)
    inf, nan = float("inf"), float("nan")
    v = [x.tolist() for x in rng.normal(size=(150, 6)).round(1)]
    v[3], v[4], v[5], v[6], v[7], v[8], v[9] = None, [], [0.0] * 6, [1.0, 2.0], [1.0, None, 2.0, 3.0, 4.0, 5.0], [nan] * 6, [inf, 1.0, 1.0, 1.0, 1.0, 1.0]
    for i in range(20, 60):
        v[i] = v[10]  # equal vectors: ties by id
    v[60] = [1e200] * 6
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    asked = rows.filter("id % 3 = 0 or id < 12").withColumnRenamed("id", "q")
    pairs = rows.filter("v is not null").crossJoin(asked.filter("v is not null").withColumnRenamed("v", "w")).filter("id != q").withColumn("score", S.cosine(F.col("v"), F.col("w")))
    want = {(r["q"], r["id"], str(r["score"] + 0.0)) for r in J.top_per_group(pairs, ["q"], [F.desc("score"), "id"], 4).collect()}
    got = [(r["q"], r["id"], str(r["score"] + 0.0)) for r in S.vector_hits(rows, asked, "id", "q", "v", 4, block=40, asked=9).collect()]
    assert set(got) == want and len(got) == len(want)
    assert S.vector_hits(rows.limit(0), asked, "id", "q", "v", 4).count() == 0 == S.vector_hits(rows, asked.limit(0), "id", "q", "v", 4).count()


def test_spine_search_meets_all_rows_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "cat", "other", "cats", "sat", "a", "x-y", "ünï", "the-cat", "mat."]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(200)] + [None, "", "  The \n cat ", "bathe catsup"]
    rows = spark.createDataFrame([(i, t, (i * 37 % 300) / 1000) for i, t in enumerate(texts)], "id long, text string, s double")
    said = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)] + ["the cat", "the cat", "he cat", "at", "he cats", "...", "", None, "e  CAT sa"]
    queries = spark.createDataFrame(list(enumerate(said)), "q long, said string")
    monkeypatch.setattr(J, "blocks_of", lambda *_: 3)
    found = J.spine_search(rows, queries, "id", "q", "text", "said", "s", 6)
    got = {(r["q"], r["place"]): (r["id"], round(r["score"], 9)) for r in found.collect()}
    plain = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip(" ")
    toks = lambda t: [w for w in re.split("[^a-z0-9]+", t) if len(w) > 1]
    want = {}
    for q, ask in enumerate(map(plain, said)):
        a, scored = toks(ask), []
        for i, h in enumerate(map(plain, texts)):
            t, whole = set(toks(h)), ask in h
            if a:
                like = 1.0 if whole else len(set(a) & t) / max(1, len(set(a) | t))
                scored.append((-round(0.44 * sum(w in t for w in a) / len(a) + 0.16 * whole + 0.22 * like + (i * 37 % 300) / 1000, 9), i))
        for place, (score, i) in enumerate(sorted(x for x in scored if x[0] < -0.12)[:6], 1):
            want[q, place] = (i, -score)
    assert got == want and len(got) > 300


def test_words_hold_texts_wherever_they_stand():
    texts = ["the cat sat", "bathe cat sats", "the", "", "he", "a the cat", "the  x", "cat the cat the cats"]
    words = Words(pa.array(texts, pa.large_string()))
    for asked in ["the", "he", "e", "the cat", "he cat", "e cat sa", "cat the cat the", "t the cat the c", "cat", "zzz", "the zzz cat", "the cat sat x", "a the cat"]:
        assert words.holding(asked).tolist() == [i for i, t in enumerate(texts) if asked in t], asked


@pytest.mark.parametrize("piece", [7, 1000])
def test_tags_leave_a_block_as_a_row_a_text(spark, monkeypatch, piece):
    rng = random.Random(6)
    monkeypatch.setattr(PH, "PIECE", piece)
    monkeypatch.setattr(PH, "blocks_of", lambda *_: 3)
    letters = "abéß日 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))).upper() for _ in range(150)] + [None, "", "a"]
    rows = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], "id long, text string")  # some ids twice
    aliases = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)] + ["", None, "a", "AB", "zzzzz"]
    words = spark.createDataFrame([(i, a, f"tag {i % 9}" if i % 13 else None) for i, a in enumerate(aliases)], "ord long, alias string, tag string")
    got = {r["id"]: (r["n"], list(r["tags"])) for r in PH.alias_tags(rows, words, "id", "text", "alias", "tag", [F.desc("ord")], 3).collect()}
    known = {}
    for i, a in enumerate(aliases):
        if a:
            known.setdefault(a.lower(), i)
    want = {}
    for i in range(140):
        held = [t.lower() for k, t in enumerate(texts) if k % 140 == i and t is not None]
        hits = sorted((o for a, o in known.items() if any(a in t for t in held)), reverse=True)
        tags = list(dict.fromkeys(f"tag {o % 9}" if o % 13 else None for o in hits))
        if hits:
            want[i] = (len(hits), tags[:3])
    assert got == want and len(got) > 100
    assert PH.alias_tags(rows, words.limit(0), "id", "text", "alias", "tag", ["ord"], 3).count() == 0


def test_vault_by_runs_equals_vault_by_rarest_tokens(spark):
    rng = random.Random(2)
    words = [f"w{i}" * (i % 3 + 1) for i in range(12)]
    pages = spark.createDataFrame([(i // 4, i, " ".join(rng.choices(words, k=rng.randint(0, 30))) if i % 9 else None, "s") for i in range(80)], "doc long, page long, text string, subject string")
    wants = {tuple(rng.choices(words, k=rng.randint(1, 3))) for _ in range(90)}
    table = spark.createDataFrame([(i, list(w), " ".join(w)) for i, w in enumerate(sorted(wants))], "ord long, want array<string>, concept string")
    made = lambda want, **more: D.vault(pages, table, "doc", "page", "text", "subject", "concept", want, [], 3, 5, 4, **more)
    rows = lambda tables: [sorted(map(str, df.collect())) for df in tables]
    got = rows(made("concept", sizes=[1, 2, 3]))
    assert got == rows(made("want")) and len(got[2]) > 5
    hits = {(r["page"], tuple(r["want"])) for r in PH.run_hits(pages.withColumn("t", F.split("text", " ")), table, "page", "t", "concept", [2]).collect()}
    want = {(r["page"], w) for r in pages.collect() for w in wants if len(w) == 2 and r["text"] and f" {' '.join(w)} " in f" {r['text']} "}
    assert hits == want and want


def test_near_vectors_are_told_by_keys_within_a_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    keys, probes = rng.integers(0, 6, (50, 3)), rng.integers(0, 6, (8, 6))
    met = B._meeting(keys, probes, 3)(np.array([5, 2]))
    want = [[any(keys[r, t] in probes[q, 2 * t : 2 * t + 2] for t in range(3)) for r in range(50)] for q in (5, 2)]
    assert met.tolist() == want
    v = rng.normal(size=(400, 5))
    v[50:120] = v[3]  # equal vectors
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    asked = rows.filter("id % 9 = 0 or id = 3").withColumnRenamed("id", "q")
    one = lambda: sorted((r["q"], r["r"], r["id"], round(r["score"], 9)) for r in B.near_vectors(rows, asked, "id", "q", "v", 6, tables=4, lines=3).collect())
    whole = one()
    monkeypatch.setattr(B, "ROWS", 90)
    monkeypatch.setattr(B, "QUERIES", 20)
    assert one() == whole and [x[2] for x in whole if x[0] == 3] == list(range(50, 56))


def test_staged_matches_find_who_matched_without_the_pairs(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "b a"), (3, "x y"), (4, ""), (5, "a b")]
    left = spark.createDataFrame(rows, "a long, n string").withColumn("w", F.split("n", " ")).withColumn("t", F.array(F.lit("z")))
    right = spark.createDataFrame([(10, "a b"), (10, "c d"), (10, "a b"), (11, "d c"), (12, "x q"), (13, "a b"), (14, "")], "b long, n string").withColumn("w", F.split("n", " ")).withColumn("t", F.array(F.lit("z")))
    got = sorted((r["a"], r["b"], r["stage"]) for r in M.staged_matches(left, right, "a", "b", "n", "w", "t").collect() if r["stage"] != "scored")
    assert got == [(1, 10, "exact"), (1, 13, "exact"), (2, 10, "signature"), (2, 13, "signature"), (5, 10, "exact"), (5, 13, "exact")]
    pairs, met = M._equal_pairs(left.select("a", "n"), right.select("b", "n"), "a", "b", "n")
    assert sorted(r["a"] for r in met.collect()) == [1, 4, 5]
    assert pairs.count() == 5  # (1, 10) once, though two of its texts are equal
