"""Positional search, bucketed vectors, dictionaries, deep trees, bucketed tables and event-time streams: cases and brute force."""

import glob
import os
import random
import shutil
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslink.catalogue import QUERIES
from corpuslink.operators import buckets as B
from corpuslink.operators import phrases as PH
from corpuslink.operators import positional as PO
from corpuslink.operators import rounds as RO
from corpuslink.sources.bucketed import BucketTable, merging_sink, refreshed_set
from corpuslink.streaming import counters as C
from corpuslink.streaming import ordered as OR

DATA = "/root/testdata/sf0.001"


# ---- cover density ----


def plain_covers(places):
    """All stretches that hold every term and no smaller one that does; 0.1 by one and the other positions inside."""
    hits = sorted((p, k) for k, ps in enumerate(places) for p in ps)
    found = []
    for i, (a, _) in enumerate(hits):
        for j in range(i, len(hits)):
            if len({k for _, k in hits[i : j + 1]}) == len(places):
                found.append((a, hits[j][0], j - i + 1))
                break
    minimal = [c for c in found if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in found)]
    return sum(0.1 / (1 + (b - a) - (n - 1)) for a, b, n in minimal)


def test_cover_density_equals_all_minimal_stretches(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(200):
        m = rng.randint(1, 4)
        spots = rng.sample(range(1, 60), rng.randint(m, 20))
        places = [spots[k::m] for k in range(m)]
        rows.append((i, [(p, k) for p, k in sorted((p, k) for k, ps in enumerate(places) for p in ps)], m))
        want.append(plain_covers(places))
    df = spark.createDataFrame(rows, "i int, hits array<struct<pos:int,k:int>>, m int")
    got = [r[0] for r in df.orderBy("i").select(PO.cover_density(F.col("hits"), F.col("m"))).collect()]
    assert np.allclose(got, want)


def test_cover_density_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha delta"), (2, None), (3, ""), (4, "beta filler filler alpha beta")], "id long, text string")
    index = PO.positional_index(docs.select("id", PO.positioned_tokens("text", []).alias("p")), "id", "p")
    asked = spark.createDataFrame([(1, ["alpha", "beta", "alpha"]), (2, []), (3, None), (4, ["alpha", "missing"]), (5, ["alpha", None, ""])], "q long, t array<string>")
    got = {(r["q"], r["id"]): round(r["score"], 6) for r in PO.cover_density_hits(index, asked, "id", "q", "t").collect()}
    assert got == {(1, 1): 0.1, (1, 4): round(0.1 / 3 + 0.1, 6), (5, 1): 0.1, (5, 4): 0.1}
    assert PO.cover_density_hits(index.limit(0), asked, "id", "q", "t").count() == 0


# ---- vectors ----


def test_near_vectors_recall_and_share(spark):
    rows = [(r["query_id"], r["vec_id"]) for r in QUERIES["search_vectors_of_queries"](spark, "/root/testdata/sf0.1").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["search_near_vectors"](spark, "/root/testdata/sf0.1").collect()}
    assert sum(x in got for x in rows) / len(rows) >= 0.9


def test_near_vectors_meet_few_where_there_are_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    v = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(2400, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    asked = rows.filter("id % 40 = 0").withColumnRenamed("id", "q")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in B.near_vectors(rows, asked, "id", "q", "v", 5, tables=8, width=0.1).collect():
        got.setdefault(r["q"], []).append((r["r"], r["id"]))
    assert len(got) == 60
    for q, found in got.items():
        near = u @ u[q]
        near[q] = -2
        assert [i for _, i in sorted(found)] == np.argsort(-near, kind="stable")[:5].tolist()
    known = B.keyed(rows.select("id", B.unit(F.col("v")).alias("v")), "v", 8, 8, 0.1, 7).select("id", F.explode(B._keys(F.col("h"))).alias("key"))
    asking = B.keyed(asked.select("q", B.unit(F.col("v")).alias("v")), "v", 8, 8, 0.1, 7).select("q", F.explode(B._probes(F.col("h"), 8)).alias("key"))
    met = asking.join(known, "key").select("q", "id").distinct().count()
    assert met < 0.05 * 60 * 2400


def test_near_vectors_of_equal_null_and_few_rows(spark):
    same = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    rows = spark.createDataFrame([*same, (900, None), (901, [0.0] * 4), (902, [0.0, 1.0, 0.0, 0.0]), (903, [1.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(3, [2.0, 0.0, 0.0, 0.0]), (902, [0.0, 1.0, 0.0, 0.0]), (7, None)], "q long, v array<double>")
    got = {}
    for r in B.near_vectors(rows, asked, "id", "q", "v", 4).orderBy("q", "r").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got[3] == [0, 1, 2, 4] and len(got[902]) == 4 and 7 not in got
    assert B.near_vectors(rows.limit(0), asked, "id", "q", "v", 4).count() == 0


# ---- dictionaries ----


def test_phrases_against_plain_search(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 60))]) for i in range(120)] + [(500, None)]
    phrases = [(k, [rng.choice(words) for _ in range(rng.randint(1, 4))]) for k in range(150)] + [(999, []), (998, None)]
    rows, table = spark.createDataFrame(docs, "id long, toks array<string>"), spark.createDataFrame(phrases, "ord long, want array<string>")
    got = {(r["id"], r["ord"], r["start"]) for r in PH.phrase_hits(rows, table, "id", "toks", "want").collect()}
    first = {}
    for k, p in phrases:
        if p:
            first.setdefault(tuple(p), k)
    want = set()
    for i, toks in docs:
        for p, k in first.items():
            at = [s for s in range(len(toks or []) - len(p) + 1) if tuple(toks[s : s + len(p)]) == p]
            if at:
                want.add((i, k, at[0]))
    assert got == want
    assert PH.phrase_hits(rows, table.limit(0), "id", "toks", "want").count() == 0


def test_aliases_against_plain_search(spark):
    docs = [(1, "The Socialist états 😀 union"), (2, None), (3, ""), (4, "so"), (5, "xünionx abcd")]
    aliases = ["socialis", "état", "union", "so", "o", "bcd", "😀 u", "missing", "", None, "UNION"]
    rows = spark.createDataFrame(docs, "id long, text string")
    table = spark.createDataFrame([(k, a) for k, a in enumerate(aliases)], "ord long, alias string")
    got = {(r["id"], r["ord"]) for r in PH.alias_hits(rows, table, "id", "text", "alias").collect()}
    want = {(i, k) for i, t in docs for k, a in enumerate(aliases[:10]) if t and a and a.lower() in t.lower()}
    assert got == want


# ---- trees ----


def test_tree_of_a_thousand_levels(spark):
    nodes = [(i, i - 1 if i else None, f"l{i}") for i in range(1000)] + [(2000, 5000, "orphan"), (3000, 3001, "a"), (3001, 3000, "b"), (3002, 3000, "below"), (7, 6, "l7")]
    counts = [(999, 7), (500, 1), (2000, 2), (3002, 4), (77777, 9)]
    got = {r["id"]: r for r in RO.tree_sums(spark.createDataFrame(nodes, "id long, up long, label string"), spark.createDataFrame(counts, "id long, n long"), "id", "up", "label").collect()}
    assert len(got) == 1004 and got[0]["n"] == 8 and got[500]["n"] == 8 and got[501]["n"] == 7
    assert got[999]["depth"] == 999 and got[999]["path"] == [f"l{i}" for i in range(1000)]
    assert got[2000]["path"] == ["orphan"] and got[2000]["n"] == 2
    assert [got[i]["n"] for i in (3000, 3001, 3002)] == [None] * 3 and got[3002]["path"] is None


def test_tree_of_nothing(spark):
    none = spark.createDataFrame([], "id long, up long, label string")
    assert RO.tree_sums(none, spark.createDataFrame([], "id long, n long"), "id", "up", "label").count() == 0


# ---- tables in buckets ----


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_bucket_table_rewrites_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], buckets=16)
    start = [(i, f"v{i}", 0) for i in range(400)]
    table.replace(spark.createDataFrame(start, "k long, v string, at long"))
    one = spark.createDataFrame([(7, "new", 1), (7, "older", 0), (7, "newer", 2)], "k long, v string, at long")
    before = {f for f in glob.glob(f"{path}/data/*/*/*.parquet")}
    assert table.merge(one, ["at"], 3) == 1
    new = {f for f in glob.glob(f"{path}/data/*/*/*.parquet")} - before
    assert len({os.path.dirname(f) for f in new}) == 1 and sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, before)) / 4
    want = {**{k: (k, v, a) for k, v, a in start}, 7: (7, "newer", 2)}
    assert rows_of(table) == sorted(want.values())
    assert table.merge(one.withColumn("v", F.lit("again")), ["at"], 3) == 0 and rows_of(table) == sorted(want.values())
    assert table.merge(spark.createDataFrame([(7, "late", 1), (1000, "x", 1)], "k long, v string, at long"), ["at"], 9) <= 2
    assert dict((r[0], r[1]) for r in rows_of(table))[7] == "newer" and len(rows_of(table)) == 401
    assert table.update(spark.createDataFrame([(5, "u"), (4444, "no")], "k long, v string"), "v", 0) <= 2
    assert dict((r[0], r[1]) for r in rows_of(table))[5] == "u" and len(rows_of(table)) == 401
    held = rows_of(table)
    assert table.vacuum(1) > 0 and rows_of(BucketTable(spark, path, ["k"])) == held and BucketTable(spark, path, ["k"]).n == 16
    with pytest.raises(ValueError, match="keys"):
        BucketTable(spark, path, ["v"])


def test_bucket_table_after_a_failure_and_against_another_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], buckets=4)
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long")
    broken = batch.withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken, ["at"], 0)
    assert table.state() is None
    assert table.merge(batch, ["at"], 0) > 0 and len(rows_of(table)) == 2
    state = table.state()
    table.merge(spark.createDataFrame([(3, "c", 1)], "k long, v string, at long"), ["at"], 1)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(state, batch.schema, {}, {})
    assert len(rows_of(table)) == 3
    table.merge(batch.limit(0), ["at"], 2)
    assert table.state()["writers"]["merge"] == 2 and len(rows_of(table)) == 3


def test_stream_merges_into_an_existing_table(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k long, v string, at long"
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    table.replace(spark.createDataFrame([(i, "old", 0) for i in range(50)], schema))
    for n in range(3):
        spark.createDataFrame([(n, f"s{n}", 5), (0, f"z{n}", n)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for checkpoint in ("a", "b"):  # replayed from the beginning under the same name: nothing changes
        q = stream.writeStream.foreachBatch(merging_sink(table, ["at"], "s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r[0]: r[1] for r in rows_of(table)}
    assert len(got) == 50 and got[0] == "s0" and got[1] == "s1" and got[2] == "s2" and got[3] == "old"


def test_refreshed_set_checks_keys_and_links(spark, tmp_path):
    people, cars = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(10, 1), (11, None)], "id long, owner long")
    keys, links = {"people": ["id"], "cars": ["id"]}, [("cars", "owner", "people", "id")]
    assert refreshed_set({"cars": cars, "people": people}, str(tmp_path), "v1", keys, links) == ["people", "cars"]
    for wrong, said in ((cars.union(cars), "repeated"), (spark.createDataFrame([(12, 5)], "id long, owner long"), "without people")):
        with pytest.raises(ValueError, match=said):
            refreshed_set({"cars": wrong, "people": people}, str(tmp_path), "v2", keys, links)
    assert spark.read.json(f"{tmp_path}/current").first()["version"] == "v1"


# ---- streams in event time ----

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "user_id long, event_id long, ts timestamp"


def feed(spark, path, batch):
    spark.createDataFrame([(u, e, T0 + timedelta(seconds=s)) for u, e, s in batch], EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_anchored_quota_stream_equals_batch_through_pauses_and_disorder(spark, tmp_path):
    rng = random.Random(6)
    events = sorted((rng.randint(1, 5), e, rng.randint(0, 4000) + rng.random()) for e in range(400))
    events = [(u, e, round(s, 3)) for e, (u, _, s) in enumerate(sorted(events, key=lambda x: x[2] + rng.random() * 50))]
    path = str(tmp_path / "in")
    parts = [events[i : i + 80] for i in range(0, 400, 80)]
    for part in parts:
        feed(spark, path, part)
    flush = [(99, 10_000, 90_000), (99, 10_001, 200_000)]
    for x in flush:
        feed(spark, path, [x])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    out = OR.anchored_quota_in_time(stream, "user_id", "event_id", 3, 60.0, late="5 minutes")
    for trigger in range(2):  # stopped and started again: idle for as long as that takes
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if not trigger:
            feed(spark, path, [(99, 10_002, 300_000)])
    got = {r["event_id"]: r["ok"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = spark.createDataFrame([(u, e, T0 + timedelta(seconds=s)) for u, e, s in events], EVENTS)
    want = {r["event_id"]: r["ok"] for r in C.anchored_quota(table, "user_id", "event_id", 3, 60.0).collect()}
    assert {k: v for k, v in got.items() if k < 10_000} == want and 0 < sum(want.values()) < 400


def test_late_rows_are_counted(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    feed(spark, path, [(1, 1, 0), (2, 2, 10), (1, 3, 20)])
    feed(spark, path, [(3, 4, 9000)])
    feed(spark, path, [(8, 9, 9000)])  # late rows are told by the watermark of the batch before
    feed(spark, path, [(4, 5, 9001), (5, 6, 1), (6, 7, 2)])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    firsts = OR.first_arrivals(OR.counted(stream, "in"), ["user_id"], late="1 minute")
    sink = OR.appending_sink(str(tmp_path / "out"), ["user_id"], ["ts", "event_id"], lambda df: df.withColumn("status", F.lit("ok")))
    q = firsts.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = sorted((r["user_id"], r["event_id"], r["status"]) for r in spark.read.parquet(*glob.glob(f"{tmp_path}/out/batch=*")).collect())
    assert seen == [(1, 1, "ok"), (2, 2, "ok"), (3, 4, "ok"), (4, 5, "ok"), (8, 9, "ok")]
    assert OR.late_rows(q) == 2 and OR.arrived(q, "in") == 8


def test_appending_sink_keeps_the_first_result_of_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = OR.appending_sink(path, ["k"], ["at"])
    batch = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    sink(batch((1, 5, "a"), (1, 3, "b"), (2, 1, "c")), 0)
    sink(batch((1, 1, "late"), (3, 1, "d")), 4)
    sink(batch((1, 1, "late"), (3, 1, "d")), 4)
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(*glob.glob(f"{path}/batch=*")).collect())
    assert got == [(1, "b"), (2, "c"), (3, "d")]
    shutil.rmtree(path)


# ---- question texts ----


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Don't stop", "don t stop"), ("Explain (10 marks, 150 words) this", "explain this"), ("Why [20 Marks]?", "why"), ("Give 5 marks / 100 words reasons", "give reasons"),
        ("Q. 12 b) Discuss", "discuss"), ("3. Analyse", "analyse"), ("12 men", "12 men"), ("R&D costs", "r and d costs"), ("benchmark 5 marksmen", "benchmark 5 marksmen"),
        ("quality", "uality"), (None, ""), ("Qa: Is it", "is it"),
    ],
)
def test_question_normalise(spark, said, want):
    from corpuslink.functions import text as T

    assert spark.createDataFrame([(said,)], "text string").select(T.question_normalise("text")).first()[0] == want


def test_stem(spark):
    from corpuslink.functions import text as T

    want = {
        "organisation": "organization", "organisations": "organization", "psychoanalys": "psychoanalysi", "analysis": "analysi", "nineteenth": "19th", "twentieth": "20th", "policies": "policy",
        "series": "series"[:-1], "working": "working", "governing": "govern", "wanted": "wanted", "governed": "govern", "class": "class", "rights": "right", "state": "state",
    }
    got = spark.createDataFrame([(w,) for w in want], "t string").select("t", T.stem(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == want


# ---- placement ----


def test_placement_by_candidates_equals_all_nodes(spark):
    from corpuslink.operators import placement as PL

    rng = random.Random(12)
    words = ["rural", "urban", "history", "of", "trade", "art", "law", "river", "ii", "the", "in", "party", "agriculture"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    nodes = [(i, f"n{i}", rng.choice(["a", "b", "c"]), text(3) or "x", rng.choice(["gs", "law", ""])) for i in range(60)] + [(99, "n99", "a", None, None)]
    rows = [(i, [text(3) for _ in range(rng.randint(0, 3))], text(7), rng.choice([["a"], ["b", "c"], [], None]), rng.choice(["a", "b", None]), rng.choice(["a", "b", "c", None])) for i in range(150)]
    rows += [(500, None, None, None, None, None), (501, [None], "rural", [], None, "a")]
    n = spark.createDataFrame(nodes, "ord long, node_id string, subject string, label string, paper string")
    r = spark.createDataFrame(rows, "id long, tags array<string>, question string, subjects array<string>, hint string, fallback string")
    args = ("tags", "question", "subjects", "hint", "fallback", ["paper"], ["the"])
    want, got = (sorted(map(tuple, f(r, n, *args).select("id", "node_id", "subject", "score", "stage").collect())) for f in (PL.placed, PL.placed_by_candidates))
    assert got == want and {x[4] for x in got} == {"matched", "within", "made"}
    assert {x[4] for x in map(tuple, PL.placed_by_candidates(r, n.limit(0), *args).select("id", "node_id", "subject", "score", "stage").collect())} == {"made"}


def test_placement_of_essays(spark):
    from corpuslink.operators import placement as PL

    nodes = spark.createDataFrame([(1, "e1", "essay", "life and death", "essay"), (2, "a1", "a", "rural trade", "gs")], "ord long, node_id string, subject string, label string, paper string")
    prompts = spark.createDataFrame([("Q1. Life is a journey", "e1"), (None, "e1")], "prompt string, node_id string")
    rows = [(1, ["life and death"], "3) Life is a Journey!", ["essay"], None, "essay"), (2, [], "unknown words", ["essay"], None, "essay"), (3, ["rural trade"], "x", ["a"], None, "essay")]
    r = spark.createDataFrame(rows, "id long, tags array<string>, question string, subjects array<string>, hint string, fallback string")
    got = {x["id"]: (x["node_id"], x["stage"]) for x in PL.placed_by_candidates(r, nodes, "tags", "question", "subjects", "hint", "fallback", [], [], "essay", prompts).collect()}
    assert got == {1: ("e1", "prompt"), 2: ("essay:topic:fallback:general-essay-theme", "made"), 3: ("a1", "matched")}


# ---- themes, synonyms ----


def test_theme_graph_against_all_pairs(spark):
    from corpuslink.operators import themes as TH

    rng = random.Random(8)
    rows = [(i % 35, rng.choice(["p", "q", None]), [rng.choice([" A", "b", "c ", "d", "", None, "e"]) for _ in range(rng.randint(0, 9))]) for i in range(40)] + [(99, "p", None)]
    df = spark.createDataFrame(rows, "id long, subject string, themes array<string>")
    of = {}
    for i, s, ts in rows:
        of.setdefault(i, set()).update(x.strip().lower() for x in ts or [] if x and x.strip())
    want = {}
    for ts in of.values():
        for a in ts:
            for b in ts:
                if a < b:
                    n, w = want.get((a, b), (0, 0))
                    want[a, b] = n + 1, w + 1 / (len(ts) - 1)
    got = {(r["a"], r["b"]): (r["shared"], r["weight"]) for r in TH.theme_graph(df, "id", "themes").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    entities = {r["name"]: r for r in TH.theme_entities(df, "id", "themes", "subject").collect()}
    assert {k: r["n"] for k, r in entities.items()} == {t: sum(t in ts for ts in of.values()) for t in set().union(*of.values())}
    assert all(r["cross"] == (len(r["subjects"]) > 1) for r in entities.values())


def test_synonym_classes_and_folding(spark):
    from corpuslink.operators import synonyms as SY

    chain = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(60)] + [("equal", "equity"), ("fair", "equal"), ("x", "x"), (None, "y"), ("", "z")]
    table = SY.classes(spark.createDataFrame(chain, "a string, b string"))
    got = {r["token"]: r["class"] for r in table.collect()}
    assert got == {**{f"t{i:03d}": "t000" for i in range(61)}, "equal": "equal", "equity": "equal", "fair": "equal"}
    rows = spark.createDataFrame([(1, ["fair", "law", "equity", "2020"]), (2, None), (3, [])], "id long, w array<string>")
    folded = {r["id"]: r["w"] for r in SY.folded(rows, "id", "w", table).collect()}
    assert folded == {1: ["equal", "law", "equal", "2020"], 2: [], 3: []}
    signed = SY.folded(rows, "id", "w", table).select("id", SY.ordered_signature(SY.core(F.col("w"), ["the"])).alias("s")).collect()
    assert {r["id"]: r["s"] for r in signed} == {1: "equal law", 2: "", 3: ""}
    assert SY.classes(spark.createDataFrame([], "a string, b string")).count() == 0


def test_items_lines_and_mentions_are_trimmed(spark):
    """``trim`` takes a second argument, so that a bare ``F.trim`` in ``transform`` would trim the item's number."""
    from corpuslink.functions import tags as TG
    from corpuslink.functions import text as T

    df = spark.createDataFrame([(" 0a , b1 ,, 2 ", "  1. why is 0  \n what is 1 \n0 5 Marks 0\n1. WHY is 0\n2) when is it\n(a) why not, candidate")], "a string, b string")
    got = df.select(T.listed("a").alias("a"), T.question_lines("b", 3, 90, ["why"], ["candidate"]).alias("b"), TG.mentions("a", [("x", " [a-z0-9]+ ")]).alias("m")).first()
    assert got["a"] == ["0a", "b1", "2"] and got["b"] == ["1. why is 0", "0 5 Marks 0"] and [m["value"] for m in got["m"]] == ["0a", "b1", "2"]


def test_json_of_any_depth(spark):
    from corpuslink.sources import trees

    import json

    node = {"name": "deep", "url": "u40"}
    for i in range(40):
        node = {"child": node} if i % 2 else {"list": [node]}
    body = json.dumps({"question": "top", "name": "n0", "url": "u0", "more": node})
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "id long, body string")
    args = (df, "id", "body", ["question"], ["name"], ["url"])
    assert {tuple(r) for r in trees.harvested(*args).collect()} == {(1, "top", "n0", "u0"), (1, "top", "deep", "u40")}
    assert {tuple(r) for r in trees.harvested(*args, depth=6).collect()} == {(1, "top", "n0", "u0")}
