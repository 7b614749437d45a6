"""Registered queries against DuckDB on the smallest tables, and cases of single operators."""

import glob
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslink.catalogue import ORACLES, QUERIES
from corpuslink.functions import fields as FD
from corpuslink.functions import gates as GT
from corpuslink.functions import tags
from corpuslink.functions import text as T
from corpuslink.operators import grouping as G
from corpuslink.operators import merging as M
from corpuslink.operators import people
from corpuslink.operators import ranking as R
from corpuslink.operators import search as S
from corpuslink.sources import files, imports, trees
from corpuslink.streaming import counters as C

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("Ünïcode B",)], "text string")
    assert [r[0] for r in df.select(T.search_normalise("text")).collect()] == ["", "", "n code b"]
    assert [r[0] for r in df.select(F.size(T.tokens(T.search_normalise("text")))).collect()] == [0, 0, 3]


def test_dense_ids_of_empty_table(spark):
    assert G.dense_ids(spark.createDataFrame([], "n long"), "n", "i").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    out = C.window_hits(stream, ["user_id"], width="1 day")
    q = out.writeStream.outputMode("update").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT user_id, window_start, hits FROM hits").collect()}
    assert got == {tuple(r) for r in C.window_hits(events, ["user_id"], width="1 day").collect()}


def test_anchored_quota(spark):
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 10, 20, 59))] + [(1, 4, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "k long, id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    ok = {r["id"]: r["ok"] for r in C.anchored_quota(df, "k", "id", 2).collect()}
    assert ok == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_unbounded_groups_stream(spark):
    """No plan gathers all rows of a key; a key in many batches keeps its count; null keys and times have rows."""
    for name, parts in (("stream_anchored_quota", ("FlatMapGroups",)), ("documents_json_harvest", ("collect_list",))):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in parts), name
    assert "row_number" in QUERIES["rollup_review_queue"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, 1).alias("k"), "id", F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("ts"))
    got = C.anchored_quota(rows, "k", "id", 2).groupBy("k").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).collect()
    assert {tuple(r) for r in got} == {(1, 20_000, 2 * 167), (None, 10_000, 2 * 167)}


def test_grid_to_records(spark):
    grid = spark.createDataFrame(
        [("f", "s", 0, ["Disclaimer: none", None]), ("f", "s", 1, ["Name", "Question Text"]), ("f", "s", 2, ["Ann", "Why?"]), ("f", "s", 3, ["", "How?"])],
        "source_file string, sheet_name string, row_index int, cells array<string>",
    )
    heads = files.header_rows(grid, ["name", "question"], ["disclaimer"])
    got = {r["row_index"]: r["record"] for r in files.records(grid, heads).collect()}
    assert got == {2: {"name": "Ann", "question_text": "Why?"}, 3: {"question_text": "How?"}}


def test_publish_only_changes(spark, tmp_path):
    df = spark.range(3)
    assert files.publish(df, str(tmp_path), "v1")
    assert not files.publish(df, str(tmp_path), "v2")
    assert files.publish(spark.range(4), str(tmp_path), "v3")


def test_harvest_inherits_the_question(spark):
    body = '{"question": "Why?", "list": [{"name": " Ann ", "url": "u1"}, {"text": "How?", "x": {"name": "Bo", "url": "u2"}}]}'
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, "[1, 2]")], "id int, body string")
    got = {tuple(r) for r in trees.harvested(df, "id", "body", ["question", "text"], ["name"], ["url"]).collect()}
    assert got == {(1, "Why?", "Ann", "u1"), (1, "How?", "Bo", "u2")}


def test_segments_and_mentions(spark):
    df = spark.createDataFrame([("before # A\none # B\ntwo",), ("plain",), (None,)], "t string")
    got = [[(s["n"], s["heading"], s["body"]) for s in r[0]] for r in df.select(tags.segments("t", "# ([A-Z])\n")).collect()]
    assert got == [[(1, "A", "one "), (2, "B", "two")], [(1, None, "plain")], [(1, None, "")]]
    found = df.select(tags.mentions("t", [("cap", "[A-Z]"), ("word", "[a-z]{6}")])).collect()[0][0]
    assert [tuple(x) for x in found] == [("cap", "A"), ("cap", "B"), ("word", "before")]


def test_names(spark):
    df = spark.createDataFrame([("drive_Ann-Lee_AIR 12 Test 2019.pdf",), (None,)], "t string")
    assert [tuple(r) for r in df.select(people.file_name_text("t"), people.name_key("t", ["test", "pdf"])).collect()] == [
        ("Ann Lee AIR 12 Test 2019", "drive ann-lee air ."), ("", ""),
    ]


def test_placement_of_odd_rows(spark):
    from corpuslink.operators import placement

    nodes = spark.createDataFrame([("n1", "a", "river basin", "A", 1), ("n2", "b", "river basin", "B", 2), ("n3", "a", None, None, 3)], "node_id string, subject string, label string, paper string, ord long")
    rows = spark.createDataFrame(
        [(1, ["River-Basin II"], "x", None, None, "b"), (2, None, None, ["a"], "a", "a"), (3, ["hills"], "a river", ["b"], "b", "b"), (4, ["hills"], "x", ["a"], None, "c"), (5, ["river basin"], "q", ["b"], "b", "b")],
        "row string, tags array<string>, question string, subjects array<string>, hint string, fallback string",
    )
    args = ("tags", "question", "subjects", "hint", "fallback", ["paper"], ["the"])
    got = {r["row"]: (r["node_id"], r["stage"]) for r in placement.placed(rows, nodes, *args).collect()}
    assert got == {"1": ("n1", "matched"), "2": ("a:topic:fallback:q", "made"), "3": ("n2", "within"), "4": ("c:topic:fallback:hills", "made"), "5": ("n2", "matched")}
    assert {r["stage"] for r in placement.placed(rows, nodes.limit(0), *args).collect()} == {"made"}
    assert placement.placed(rows.limit(0), nodes, *args).count() == 0


# ---- ranks, gates, sinks and streams ----


def one(spark, **columns):
    """The values of Columns over one row."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_exact_text_beats_tags_whatever_the_year(spark):
    rows = spark.createDataFrame([("a", "impact of climate change on farming", "environment", 2020), ("b", "monsoon patterns", "climate change", 2024)], "id string, question string, tags string, year int")
    terms = F.lit(["climate", "change"])
    toks = T.tokens(T.search_normalise(F.concat_ws(" ", "question", "tags")))
    ranked = rows.withColumn("rank", R.official_rank(terms, F.lit("climate change"), toks, T.search_normalise("question"), T.search_normalise("tags"), F.lit("")))
    assert [r["id"] for r in ranked.orderBy(*R.relevance_order()).collect()] == ["a", "b"]


def test_link_groups_put_sources_and_direct_types_first(spark):
    rows = [(1, "q", "c1", "direct", 0.7, False), (2, "q", "c1", "direct", 0.6, True), (3, "q", "c2", "topic-match", 0.99, False)]
    links = spark.createDataFrame(rows, "id long, question string, card string, kind string, confidence double, usable boolean")
    links = links.withColumn("available", F.col("usable")).withColumn("rank", F.lit(None).cast("int")).withColumn("year", F.lit(None).cast("int"))
    got = {r["card"]: r for r in R.grouped_links(links, ["card"], "id", "question").collect()}
    assert (got["c1"]["place"], got["c1"]["confidence"], list(got["c1"]["copies"])) == (1, 0.7, [2, 1]) and got["c2"]["place"] == 2


def test_workspace_orders_exact_before_broad(spark):
    rows = [("exact", "parliament and delegated legislation", 1), ("broad", "parliament in general", 9)]
    df = spark.createDataFrame(rows, "id string, question string, copies int").withColumn("path", F.array(F.lit("delegated legislation of parliament")))
    toks = T.tokens(T.search_normalise(F.concat_ws(" ", "question", F.array_join("path", " "))))
    scored = df.withColumn("score", R.workspace_score(F.lit(["parliament", "delegated", "legislation"]), F.col("question"), F.col("path"), toks))
    assert [r["id"] for r in scored.orderBy(*R.workspace_order()).collect()] == ["exact", "broad"]


def test_gates_on_odd_texts(spark):
    cases = {None: False, "": False, "NA": False, "(qna)": False, "Q12": False, "q b": False, "Q. why": False, "Discuss the role of rivers": True}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", GT.publishable("v").alias("ok"))
    assert {r["v"]: r["ok"] for r in df.collect()} == cases
    got = one(spark, a=GT.junk_value(F.lit("Not given")), b=GT.displayable(F.lit("3. [NA]")), c=GT.person_like(F.lit("GS 4"), ["^gs ?[1-4]$"]), d=GT.text_quality(F.lit("")))
    assert (got["a"], got["b"], got["c"], got["d"]) == (True, False, False, 5)


def test_fields_on_odd_texts(spark):
    got = one(
        spark, m=FD.marks(F.lit("(15 M) and 20 marks"), [10, 15, 20]), r=FD.rank_of(F.lit("AIR - 7 copy")), y=FD.year_of(F.lit("x2019x 2021")), j=FD.fenced_json(F.lit("no braces")),
        p=FD.page_status(F.lit("7.9"), F.lit(5)), s=FD.paragraph_summary(F.lit("short")), h=FD.score_hints(F.lit("Q1 7.5 /10 Q2 9 /5"))["total"], k=FD.client_key(F.lit(None), F.lit(None)),
    )
    assert (got["m"], got["r"], got["y"], got["j"], got["p"], got["s"], got["h"], got["k"]) == (20, 7, 2021, None, "out_of_range", "short…", 7.5, "local")


def test_vocabulary_hits_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 2)
    terms, tokens = ["ring", "bolts", "gear", "red", "widgets"], ["rings", "bolt", "gears", "read", "widget", "xy"]
    make = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {tuple(r) for r in R.vocabulary_hits(make("term", terms), make("token", tokens)).select("term", "token").collect()}
    pairs = make("term", terms).join(make("token", tokens)).filter(R.term_hits(F.col("term"), F.col("token")))
    assert got == {tuple(r) for r in pairs.select("term", "token").collect()} and ("ring", "rings") in got


def test_containing_equals_brute_force(spark):
    a, b = ["abcdef", "xyz", "ab", "the cat"], ["cde", "wxyz", "the cat sat", "b", "abcdef"]
    make = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {tuple(r) for r in M.containing(make("a", a), make("b", b), "a", "b").collect()}
    assert got == {(x, y) for x in a for y in b if min(len(x), len(y)) >= 3 and (x in y or y in x)}


def test_related_never_offers_more_than_scored(spark):
    rows = spark.createDataFrame([(i, "s", ["x"]) for i in range(60)], "k long, s string, terms array<string>")
    for mode in ("terms", "reference"):
        pairs = R.related(rows, "k", "s", "terms", "k", 8, mode).groupBy("k").count().collect()
        assert len(pairs) == 60 and max(r["count"] for r in pairs) == 8


def test_paths_of_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "long text"), (2, "b", "other")], "id long, paper string, question string")
    files.keyed_json(df, str(tmp_path / "k"), "paper", "id", "question", 4)
    assert sorted(os.listdir(tmp_path / "k" / "by_paper"))[-2:] == ["paper=a", "paper=b"] and spark.read.json(str(tmp_path / "k" / "index")).count() == 2
    imports.json_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    assert imports.refreshed({"q": df}, str(tmp_path / "s"), "v1") == ["q"] and spark.read.json(str(tmp_path / "s" / "current")).first()["version"] == "v1"
    new = spark.createDataFrame([(2, "B")], "id long, paper string")
    assert {r["id"]: r["paper"] for r in files.keyed_update(df, new, "id", "paper").collect()} == {1: "a", 2: "B"}
    assert files.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_backfill_keeps_known_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, ["a"], [0.5] * 4), (3, [], None)], "id long, toks array<string>, v array<float>")
    got = {r["id"]: r["v"] for r in imports.backfilled(df, "id", "toks", "v", 4).collect()}
    assert len(got[1]) == 4 and got[2] == [0.5] * 4 and got[3] is None


def test_upsert_sink_and_daily_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    write = C.upsert_sink(str(tmp_path / "t"), ["user_id"], ["ts", "event_id"])
    half = F.col("event_id") < 500
    write(events.filter(half), 0)
    write(events.filter(~half), 1)
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()}
    want = C.first_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    assert got == {r["user_id"]: r["event_id"] for r in want.collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    weights = {"click": 1, "view": 2}
    q = C.daily_activity(stream, "user_id", weights).writeStream.outputMode("update").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT user_id, day, n FROM daily").collect()} == {tuple(r) for r in C.daily_activity(events, "user_id", weights).collect()}


def test_anchored_quota_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    out = C.anchored_quota_stream(stream, "user_id", "event_id", 3, 86400.0)
    q = out.writeStream.outputMode("append").format("memory").queryName("quota").option("checkpointLocation", str(tmp_path)).start()
    want = {tuple(r) for r in C.anchored_quota(events, "user_id", "event_id", 3, 86400.0).collect()}
    try:  # a state that waits for its timeout keeps the query going, so it is stopped here
        for _ in range(60):
            if spark.sql("SELECT count(*) FROM quota").first()[0] >= len(want):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {tuple(r) for r in spark.sql("SELECT user_id, event_id, ok FROM quota").collect()} == want


def test_spread_of_a_page(spark):
    rows = spark.range(10)
    got = S.page_with_total(rows, ["id"], 8, 5).collect()
    assert [r["id"] for r in got] == [8, 9] and got[0]["total"] == 10 and got[0]["next"] is None
