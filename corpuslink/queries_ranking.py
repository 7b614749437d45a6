"""Registered queries of ranks, relations and orders, with their SQL. Query sets: every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import gates as GT
from .functions import text as T
from .operators import grouping as G
from .operators import jobs as J
from .operators import linking as L
from .operators import ranking as R
from .operators import search as S
from .queries import IDF, STOP, query
from .queries_fields import LINK, links

TOPIC_STOP = ["for", "and"]
ROW = """r AS (SELECT p_partkey AS id, lower(p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_type ELSE '' END) AS question, p_name, lower(p_type) AS tag, lower(p_brand) AS brand, lower(p_type || ' ' || string_split(p_name, ' ')[1]) AS kw,
2000 + p_size AS year, (p_size % 7)::BIGINT AS copies, p_size FROM part),
h AS (SELECT *, trim(regexp_replace(question || ' ' || tag || ' ' || brand || ' ' || kw, '[^a-z0-9]+', ' ', 'g')) AS hay FROM r),
q AS (SELECT id AS query_id, lower(p_name) || ' ' || tag AS phrase, tag || ' for ' || brand AS topic FROM r WHERE id % 50 = 0),
t AS (SELECT DISTINCT query_id, unnest(list_filter(string_split(phrase, ' '), lambda x: length(x) > 1)) AS term FROM q)"""
FUZZY = "(term = token OR (contains(term, token) AND length(token) >= 4) OR (contains(token, term) AND length(term) >= 4) OR levenshtein(term, token) <= CASE WHEN greatest(length(term), length(token)) <= 5 THEN 1 ELSE 2 END)"
TOKEN_SCORE = "CASE WHEN term = token THEN 1.0::DOUBLE WHEN contains(token, term) OR contains(term, token) THEN 0.82::DOUBLE ELSE greatest(0.4::DOUBLE, 1 - levenshtein(token, term)::DOUBLE / greatest(length(token), length(term))) END"
MATCHED = f"""ht AS (SELECT DISTINCT id, unnest(string_split(hay, ' ')) AS token FROM h),
hit AS (SELECT query_id, id, term, max({TOKEN_SCORE}) AS best, bool_or(contains(token, term) OR {FUZZY}) AS ok FROM t CROSS JOIN ht GROUP BY ALL),
m AS (SELECT query_id, id, sum(best) / count(*) AS base, count(*) AS n FROM hit GROUP BY 1, 2 HAVING bool_and(ok))"""


def field_hits(name: str, field: str) -> str:
    return f"""{name} AS (SELECT query_id, id, count(DISTINCT term) AS k FROM m JOIN t USING (query_id) JOIN (SELECT id, unnest(string_split(trim(regexp_replace({field}, '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM r) USING (id)
WHERE contains(token, term) OR {FUZZY} GROUP BY 1, 2)"""


def _rows(t):
    low, p = lambda *c: F.lower(F.concat(*c)), t("part")
    rows = p.select(
        F.col("p_partkey").alias("id"), low("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("")).alias("question"), F.lower("p_name").alias("name"),
        F.lower("p_type").alias("tag"), F.lower("p_brand").alias("brand"), low("p_type", F.lit(" "), F.get(F.split("p_name", " "), F.lit(0))).alias("kw"),
        (F.lit(2000) + F.col("p_size")).alias("year"), (F.col("p_size") % 7).cast("long").alias("copies"), "p_size",
    )
    return rows.withColumn("toks", T.tokens(T.search_normalise(F.concat_ws(" ", "question", "tag", "brand", "kw"))))


def _queries(rows):
    q = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat("name", F.lit(" "), "tag").alias("asked"), F.concat("tag", F.lit(" for "), "brand").alias("topic"))
    return q.withColumn("terms", F.array_distinct(T.terms(T.search_normalise("asked")))).withColumn("phrase", T.search_normalise("asked"))


OFFICIAL = f"""{ROW}, {MATCHED}, {field_hits('qh', 'question')}, {field_hits('sh', "tag || ' ' || brand")}, {field_hits('kh', 'kw')},
sc AS (SELECT query_id, id, year, contains(question, phrase) AS phrase_hit, coalesce(qh.k, 0) = n AS every, coalesce(qh.k, 0) AS qk, topic, tag, brand, kw,
base + CASE WHEN contains(question, phrase) THEN 1.4 ELSE 0 END + CASE WHEN coalesce(qh.k, 0) = n THEN 0.9 ELSE 0 END + coalesce(qh.k, 0) / n * 0.75 + coalesce(sh.k, 0) / n * 0.18 + coalesce(kh.k, 0) / n * 0.08 AS score
FROM m JOIN q USING (query_id) JOIN r USING (id) LEFT JOIN qh USING (query_id, id) LEFT JOIN sh USING (query_id, id) LEFT JOIN kh USING (query_id, id))"""


def _official(t, topic_stop=None):
    rows = _rows(t)
    return J.official_search(rows.withColumn("tags", F.array("tag", "brand")).withColumn("keywords", F.array("kw")), _queries(rows).select("query_id", "asked", "topic"), 5, topic_stop)


@query(f"""WITH {OFFICIAL} SELECT query_id, id, place::INT AS place, round(score, 6) AS score, phrase_hit AS phrase, every, qk::INT AS question_hits FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phrase_hit DESC, every DESC, qk DESC, round(score, 9) DESC, year DESC, id) AS place FROM sc) WHERE place <= 5""")
def search_official(t):
    return _official(t).select("query_id", "id", "place", F.round("rank.score", 6).alias("score"), "rank.phrase", F.col("rank.all_in_question").alias("every"), "rank.question_hits")


TOPIC = """tt AS (SELECT query_id, topic, trim(regexp_replace(topic, '[^a-z0-9]+', ' ', 'g')) AS ph, list_distinct(list_filter(string_split(trim(regexp_replace(topic, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ('for', 'and'))) AS w FROM q),
f AS (SELECT id, trim(regexp_replace(tag, '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(brand, '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(kw, '[^a-z0-9]+', ' ', 'g')) AS c FROM r),
x AS (SELECT query_id, id, contains(a, ph) OR contains(b, ph) OR contains(c, ph) AS whole, len(list_filter(w, lambda y: list_contains(string_split(a || ' ' || b || ' ' || c, ' '), y))) AS hits, len(w) AS n FROM tt CROSS JOIN f),
y AS (SELECT *, n > 0 AND hits = n AS every, CASE WHEN whole THEN 4 + hits / n WHEN n > 0 AND hits = n THEN 2 + hits / n WHEN hits > 0 THEN 0.5 + hits / n ELSE 0 END AS score FROM x)"""


@query(f"""WITH {ROW}, {TOPIC} SELECT query_id, id, place::INT AS place, round(score, 6) AS score, whole, every, hits::INT AS hits FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, every DESC, hits DESC, round(score, 9) DESC, id) AS place FROM y WHERE score > 0) WHERE place <= 8""")
def search_topics(t):
    rows = _rows(t)
    top = J.topic_search(rows, _queries(rows), ["tag", "brand", "kw"], TOPIC_STOP, 8).select("query_id", "id", "place", "topic_rank.*")
    return top.select("query_id", "id", "place", F.round("score", 6).alias("score"), F.col("phrase").alias("whole"), "every", "hits")


@query(f"""WITH {OFFICIAL}, {TOPIC} SELECT query_id, id, place::INT AS place, round(a.score, 6) AS score, round(coalesce(b.score, 0), 6) AS topic_score FROM (
SELECT query_id, id, a.score, b.score AS ts, row_number() OVER (PARTITION BY query_id ORDER BY phrase_hit DESC, a.every DESC, qk DESC, round(a.score, 9) DESC, b.whole DESC, b.every DESC, b.hits DESC, round(b.score, 9) DESC, year DESC, id) AS place
FROM sc a JOIN y b USING (query_id, id) WHERE b.score > 0) z(query_id, id, sa, sb, place) JOIN sc a USING (query_id, id) JOIN y b USING (query_id, id) WHERE place <= 5""")
def search_official_filtered(t):
    return _official(t, TOPIC_STOP).select("query_id", "id", "place", F.round("rank.score", 6).alias("score"), F.round("topic.score", 6).alias("topic_score"))


@query(f"""WITH {ROW}, {MATCHED}, w AS (SELECT query_id, id, term, best, question, copies, contains(question, term) AS a, contains(tag, term) OR contains(brand, term) AS b,
contains(tag || ' ' || brand, term) OR len(list_filter(string_split(trim(regexp_replace(tag || ' ' || brand, '[^a-z0-9]+', ' ', 'g')), ' '), lambda token: {FUZZY})) > 0 AS c FROM m JOIN hit USING (query_id, id) JOIN r USING (id)),
s AS (SELECT query_id, id, question, copies, sum(best + CASE WHEN a THEN 5 WHEN b THEN 3 WHEN c THEN 2.25 ELSE 1 END) AS score FROM w GROUP BY ALL)
SELECT query_id, id, place::INT AS place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, copies DESC, question, id) AS place FROM s) WHERE place <= 5""")
def search_workspace(t):
    rows = _rows(t)
    found = J.workspace_search(rows.withColumn("path", F.array("tag", "brand")).withColumn("more", F.col("kw")), _queries(rows), 5)
    return found.select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(f"""WITH {ROW}, z AS (SELECT query_id, id, term, trim(regexp_replace(question, '[^a-z0-9]+', ' ', 'g')) AS ti, trim(regexp_replace(brand, '[^a-z0-9]+', ' ', 'g')) AS pe, tag AS co,
trim(regexp_replace(question || ' ' || brand || ' ' || tag || ' ' || kw, '[^a-z0-9]+', ' ', 'g')) AS ha, p_size FROM t CROSS JOIN r),
s AS (SELECT query_id, id, 1 + sum(CASE WHEN contains(ha, term) THEN CASE WHEN length(term) > 4 THEN 8 ELSE 4 END ELSE 0 END + CASE WHEN contains(ti, term) THEN 10 ELSE 0 END + CASE WHEN contains(pe, term) THEN 12 ELSE 0 END
+ CASE WHEN contains(co, term) THEN 8 ELSE 0 END) + least(8.0, any_value(p_size) / 30) + CASE WHEN any_value(p_size) % 3 > 0 THEN 1.5 ELSE 0 END + CASE WHEN any_value(p_size) % 2 > 0 THEN 1.5 ELSE 0 END AS score FROM z GROUP BY 1, 2 HAVING bool_or(contains(ha, term)))
SELECT query_id, id, place::INT AS place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM s) WHERE place <= 5""")
def search_document_scores(t):
    rows = _rows(t)
    size = F.col("p_size")
    held = rows.select("id", F.col("question").alias("title"), F.col("brand").alias("person"), F.array("tag").alias("concepts"), F.col("kw").alias("rest"), R.document_bonus(size, size % 3, size % 2).alias("bonus"))
    return J.document_search(held, _queries(rows), 5).select("query_id", "id", "place", F.round("score", 6).alias("score"))


COSINE = """list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))))"""
NEAR = f"""vq AS (SELECT vec_id AS query_id, embedding AS b FROM embeddings WHERE vec_id % 50 = 0), vs AS (SELECT query_id, vec_id, {COSINE} AS score FROM (SELECT vec_id, embedding AS a FROM embeddings) CROSS JOIN vq WHERE vec_id <> query_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM vs)"""


@query(f"WITH {NEAR} SELECT query_id, vec_id, round(score, 6) AS score FROM vr WHERE r <= 10")
def search_vectors_of_queries(t):
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return S.vector_hits(e, asked, "vec_id", "query_id", "embedding", 10).withColumn("score", F.round("score", 6))


RARE = f"""{IDF}, rq AS (SELECT doc_id AS query_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS r FROM dt JOIN idf USING (token) WHERE doc_id % 50 = 0 AND df > 1),
bq AS (SELECT query_id, token AS term FROM rq WHERE r <= 4), al AS (SELECT doc_id, toks, len(toks) AS n FROM d), st AS (SELECT count(*) AS total, avg(n) AS avg_len FROM al),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(toks) AS term FROM al) WHERE term IN (SELECT term FROM bq) GROUP BY ALL), bdf AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bs AS (SELECT query_id, doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score FROM tf JOIN bdf USING (term) JOIN bq USING (term) CROSS JOIN st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bs WHERE doc_id <> query_id)"""


def _bm25(t):
    d = t("documents").select("doc_id", T.link_tokens("text", STOP).alias("toks"))
    df = L.idf(d, "toks").filter("df > 1")
    tokens = d.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct("toks")).alias("token")).join(df, "token")
    rare = G.top_per_group(tokens, ["query_id"], ["df", "token"], 4).groupBy("query_id").agg(F.collect_list("token").alias("terms"))  # four at most
    found = S.bm25_queries(d, rare, "doc_id", "query_id", "toks", "terms").filter("doc_id != query_id")
    return G.top_per_group(found, ["query_id"], [F.desc(F.round("score", 9)), "doc_id"], 10)


@query(f"WITH {RARE} SELECT query_id, doc_id, r::INT AS rank, round(score, 6) AS score FROM br WHERE r <= 10")
def search_bm25_of_queries(t):
    return _bm25(t).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {RARE}, {NEAR}, u AS (SELECT query_id, doc_id, score / 20 AS lex, 0.0 AS sem FROM br WHERE r <= 10 UNION ALL SELECT query_id, vec_id, 0, score FROM vr WHERE r <= 10),
g AS (SELECT query_id, doc_id, max(lex) AS lex, max(sem) AS sem, 0.5 * max(lex) + 0.5 * max(sem) AS score FROM u GROUP BY 1, 2),
re AS (SELECT g.*, coalesce(0.7 * c.score, 0) + 0.3 * g.score AS rerank FROM g LEFT JOIN vs c ON c.query_id = g.query_id AND c.vec_id = g.doc_id)
SELECT query_id, doc_id, place::INT AS place, round(score, 6) AS score, round(rerank, 6) AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM re) WHERE place <= 8""")
def search_hybrid(t):
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    near = S.vector_hits(e, asked, "vec_id", "query_id", "embedding", 10).withColumnRenamed("vec_id", "doc_id")
    both = S.hybrid_queries(_bm25(t).withColumn("score", F.col("score") / 20), near, "query_id", "doc_id")
    both = both.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").join(asked.select("query_id", F.col("embedding").alias("qv")), "query_id", "left")
    known = R.reranked(both, "embedding", "qv", "score").withColumn("rerank", F.coalesce("rerank", 0.3 * F.col("score")))
    top = G.top_per_group(known, ["query_id"], [F.desc(F.round("score", 9)), "doc_id"], 8, "place")
    return top.select("query_id", "doc_id", "place", F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"))


WEIGHT = "CASE WHEN kind IN ('direct', 'exact') THEN 4 WHEN kind IN ('strong', 'high-confidence') THEN 3 WHEN kind IN ('topic-match', 'reasoned') THEN 2 WHEN kind = 'loose-topic-match' THEN 1 ELSE 0 END"
LINKED = f"""{LINK}, k AS (SELECT *, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity::BIGINT AS id, available AND page <> 0 AND status IN ('valid', 'fallback') AS usable, {WEIGHT} AS w, nullif(l_suppkey % 4, 0) AS rank, nullif(l_orderkey % 6, 0) AS year FROM link),
one AS (SELECT DISTINCT ON (id) * FROM k ORDER BY id, l_partkey, l_suppkey, confidence)"""


def _links(t):
    k = links(t).withColumn("id", F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long"))
    k = k.withColumn("usable", GT.usable_source("available", "page", "status"))
    k = k.withColumn("rank", F.nullif(F.col("l_suppkey") % 4, F.lit(0))).withColumn("year", F.nullif(F.col("l_orderkey") % 6, F.lit(0)))
    return G.first_per_key(k, ["id"], ["l_partkey", "l_suppkey", "confidence"])


@query(f"""WITH {LINKED}, b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY w DESC, confidence DESC, usable DESC, available DESC, rank NULLS LAST, year DESC NULLS LAST, id) AS r,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY usable DESC, confidence DESC, w DESC, id) AS c FROM one),
g AS (SELECT l_partkey, l_suppkey, count(*) AS n, count(*) FILTER (usable) AS n_usable, array_to_string(list(id ORDER BY c) FILTER (c <= 24), ',') AS copies FROM b GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, id, n, n_usable, copies, row_number() OVER (PARTITION BY l_partkey ORDER BY n_usable DESC, w DESC, confidence DESC, usable DESC, available DESC, rank NULLS LAST, year DESC NULLS LAST, n DESC, l_suppkey)::INT AS place,
round(w * 10 + confidence + CASE WHEN available AND status = 'valid' THEN 2 ELSE 0 END + CASE WHEN status = 'fallback' THEN 0.5 ELSE 0 END + CASE WHEN page > 0 THEN 0.25 ELSE 0 END, 6) AS value FROM g JOIN b USING (l_partkey, l_suppkey) WHERE r = 1""")
def ranking_link_groups(t):
    g = R.grouped_links(_links(t), ["l_suppkey"], "id", "l_partkey")
    value = R.copy_value(F.col("kind"), F.col("confidence"), F.col("available") & (F.col("status") == "valid"), F.col("status") == "fallback", F.col("page") > 0)
    return g.select("l_partkey", "l_suppkey", "id", "n", "n_usable", F.array_join(F.col("copies").cast("array<string>"), ",").alias("copies"), "place", F.round(value, 6).alias("value"))


@query("SELECT l_partkey, count(*) AS n, count(DISTINCT (l_suppkey, l_returnflag)) AS pairs FROM lineitem GROUP BY 1")
def ranking_pair_counts(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey", "l_returnflag").alias("pairs"))


@query("""WITH o AS (SELECT l_suppkey, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity::BIGINT AS card, l_returnflag, l_quantity FROM lineitem), d AS (SELECT DISTINCT ON (card) * FROM o ORDER BY card, l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY card) AS r FROM d)
SELECT l_suppkey, min_by(l_returnflag, card) AS l_returnflag, min_by(l_quantity, card) AS l_quantity, count(*) AS n, min(card) AS seen, array_to_string(list(card ORDER BY card) FILTER (r <= 6), ',') AS cards FROM r GROUP BY 1""")
def ranking_cards(t):
    o = t("lineitem").withColumn("card", F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long"))
    d = G.first_per_key(o, ["card"], ["l_suppkey"])
    g = R.grouped_cards(d, "l_suppkey", "card", ["l_returnflag", "l_quantity"], 6)
    return g.select("l_suppkey", "l_returnflag", "l_quantity", "n", "seen", F.array_join(F.col("cards").cast("array<string>"), ",").alias("cards"))


RELATED = """p AS (SELECT p_partkey AS k, p_brand AS s, p_size, list_distinct(list_concat(string_split(lower(p_name), ' '), [lower(p_type)])) AS terms, string_split(lower(p_name), ' ') AS kw, lower(p_type) AS tag FROM part),
e AS (SELECT k, s, unnest(terms) AS term FROM p), i AS (SELECT *, row_number() OVER (PARTITION BY s, term ORDER BY k) AS r FROM e),
c AS (SELECT DISTINCT e.k, i.k AS other FROM e JOIN i USING (s, term) WHERE i.r <= 9 AND i.k <> e.k), cc AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY other) AS r FROM c),
x AS (SELECT a.k, b.k AS other, a.tag = b.tag AS same_tag, len(list_filter(a.kw, lambda w: list_contains(b.kw, w))) AS shared, a.p_size % 4 = b.p_size % 4 AS paper FROM cc JOIN p a ON a.k = cc.k JOIN p b ON b.k = cc.other WHERE r <= 8),
y AS (SELECT *, least(24, same_tag::INT * 10 + shared * 5) AS base FROM x),
z AS (SELECT k, other, greatest(0, least(100, base + CASE WHEN paper THEN 8 ELSE 0 END + 8 + least(30, same_tag::INT * 10) + least(20, shared * 5) + least(18, shared * 3))) AS score FROM y)"""


@query(f"""WITH {RELATED}, w AS (SELECT *, greatest(800, least(2400, 900 + floor(score * 13 + 0.5)))::INT AS elo, row_number() OVER (PARTITION BY k ORDER BY score DESC, other) AS r FROM z)
SELECT k, other, score::INT AS score, elo, CASE WHEN score >= 72 THEN 'strong' WHEN score >= 48 THEN 'topic-match' WHEN score >= 28 THEN 'loose-topic-match' ELSE 'weak' END AS type, r::INT AS rank FROM w WHERE r <= 3""")
def ranking_related(t):
    p = t("part").select(
        F.col("p_partkey").alias("k"), F.col("p_brand").alias("s"), "p_size", F.split(F.lower("p_name"), " ").alias("kw"), F.array(F.lower("p_type")).alias("tag"),
    ).withColumn("terms", F.array_distinct(F.concat("kw", "tag")))
    other = p.select(F.col("k").alias("other"), F.col("kw").alias("kw2"), F.col("tag").alias("tag2"), F.col("p_size").alias("size2"))
    pairs = R.related(p, "k", "s", "terms", "k").join(p, "k").join(other, "other")
    tags, words = F.size(R.common(F.col("tag"), F.col("tag2"))), F.size(R.common(F.col("kw"), F.col("kw2")))
    base = F.least(F.lit(24), tags * 10 + words * 5)
    pairs = pairs.withColumn("m", R.match_score(base, F.lit(False), F.col("p_size") % 4 == F.col("size2") % 4, F.lit(True), tags, words, words))
    top = G.top_per_group(pairs, ["k"], [F.desc("m.score"), "other"], 3)
    return top.select("k", "other", "m.score", "m.elo", "m.type", "rank")


@query("""WITH c AS (SELECT p_partkey, p_name, 2000 + p_size AS year, p_size % 7 AS copies FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY copies ORDER BY CASE WHEN p_partkey = 77 THEN 0 ELSE 1 END, year DESC, copies DESC, p_name, p_partkey) AS place FROM c)
SELECT copies, p_partkey, place::INT AS place FROM o WHERE place <= 12""")
def ranking_catalogue(t):
    c = t("part").select("p_partkey", "p_name", (F.lit(2000) + F.col("p_size")).alias("year"), (F.col("p_size") % 7).alias("copies"))
    return G.top_per_group(c, ["copies"], R.pinned("p_partkey", 77, R.catalogue_order("year", "copies", "p_name", "p_partkey")), 12, "place").select("copies", "p_partkey", "place")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CASE WHEN 90 < (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') THEN 90 END::BIGINT AS next
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 30""")
def ranking_page(t):
    o = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return S.page_with_total(o, [F.desc("o_totalprice"), "o_orderkey"], 30, 500).withColumn("total", F.col("total").cast("long"))


@query("""SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND contains(lower(p_name), 'ring') AND len(list_filter([p_brand, p_type], lambda x: contains(lower(x), 'brand#1'))) > 0
UNION ALL SELECT p_partkey + 1000000 FROM part WHERE lower(p_type) IN ('economy', 'small')""")
def search_filters(t):
    p = t("part").withColumn("tags", F.array("p_brand", "p_type"))
    a = R.faceted(p, {"p_type": "PROMO", "p_size": None}, {"p_name": "Ring", "p_brand": ""}, {"tags": "brand#1"}).select("p_partkey")
    return a.union(p.filter(R.in_category(F.col("p_type"), "Little", {"little": ["ECONOMY", "SMALL"]})).select(F.col("p_partkey") + 1_000_000))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_name, 2000 + p_size AS year, p_size % 7 AS copies FROM part) SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY year DESC, copies DESC, p_name, p_partkey) AS r FROM c WHERE copies > 0) WHERE r = 1""")
def ranking_featured(t):
    c = t("part").select("p_partkey", "p_brand", "p_name", (F.lit(2000) + F.col("p_size")).alias("year"), (F.col("p_size") % 7).alias("copies"))
    return R.featured(c, "p_brand", "copies", R.catalogue_order("year", "copies", "p_name", "p_partkey")).select("p_brand", "p_partkey")


@query("""SELECT p_partkey, 'flagged' AS how FROM part WHERE p_size % 5 > 0 UNION ALL SELECT p_partkey, 'own' FROM part WHERE p_brand = 'Brand#3' UNION ALL SELECT p_partkey, 'found' FROM part WHERE p_type = 'PROMO' OR list_contains(string_split(upper(p_name), ' '), 'PROMO')""")
def search_points(t):
    p = t("part").withColumn("flag", F.col("p_size") % 5).withColumn("names", F.split(F.upper("p_name"), " "))
    found = R.point_lookup(p, "PROMO", "p_type", "names", "^[A-Z]+$").unionByName(R.point_lookup(p, "small ring", "p_name", "names", "^[A-Z]+$"))
    rows = [(R.flagged(p, {"flag": True, "p_size": False}), "flagged"), (R.own_rows(p, "p_brand", "Brand#3"), "own"), (found, "found")]
    a, b, c = (df.select("p_partkey", F.lit(how).alias("how")) for df, how in rows)
    return a.union(b).union(c)
