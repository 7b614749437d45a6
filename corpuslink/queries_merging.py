"""Registered queries of merges, indexes, lookups, trees and staged matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import gates as GT
from .functions import text as T
from .operators import jobs as J
from .operators import merging as M
from .operators import ranking as R
from .queries import IDF, NORMAL, STOP, _anchors, query



@query("""WITH c AS (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'na' ELSE 'l' || quality END AS lang FROM labels)
SELECT d.doc_id, coalesce(nullif(c.lang, 'na'), d.lang) AS lang, CASE WHEN d.source = 'src1' THEN 'withheld' ELSE d.source END AS source FROM documents d LEFT JOIN c USING (doc_id)""")
def merging_overlay(t):
    curated = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "na").otherwise(F.concat(F.lit("l"), F.col("quality").cast("string"))).alias("lang"))
    d = M.overlaid(t("documents").select("doc_id", "lang", "source", "n_chars"), curated, "doc_id", ["lang"], "na")
    return M.public(d, ["n_chars"], {"source": (F.col("source") == "src1", "withheld")})


@query("""SELECT conv_id, any_value(length(text)) FILTER (turn = 0)::INT AS first_size, count(*)::INT AS n_turns FROM conversations GROUP BY conv_id""")
def merging_shells(t):
    c = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max(F.when(F.col("turn") == 0, F.length("text"))).alias("first_size"))
    return M.shells(c, ["turns"])


QUALITY = r"""(CASE WHEN regexp_matches(c, '(?i)\bmarks?\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(c, '(?i)\banswer in [0-9]+ words?\b') THEN 0 ELSE 2 END
+ CASE WHEN len(regexp_extract_all(c, '(?i)\bq(?:uestion)?\.?\s*[0-9]+')) <= 1 THEN 2 ELSE 0 END + CASE WHEN length(c) <= 220 THEN 1 ELSE 0 END)"""


@query(rf"""WITH x AS (SELECT p_partkey, p_type, p_name AS k, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (10 marks)' WHEN 1 THEN p_name || ' answer in 10 words' WHEN 2 THEN 'q1 ' || p_name || ' q2' ELSE p_name END AS c,
CASE WHEN p_size % 3 > 0 THEN p_size END AS marks, p_size % 5 AS copy FROM part), q AS (SELECT *, {QUALITY} AS q FROM x),
b AS (SELECT *, q > coalesce(max(q) OVER (PARTITION BY p_type, k ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM q),
m AS (SELECT p_type, k, max_by(c, p_partkey) FILTER (better) AS text, coalesce(max_by(marks, p_partkey) FILTER (better AND marks IS NOT NULL), -1) AS marks, count(*) AS n, min(p_partkey) AS first FROM b GROUP BY 1, 2),
c AS (SELECT p_type, k, count(*) AS n_copies, array_to_string(list(copy ORDER BY first) FILTER (r <= 3), ',') AS copies FROM (SELECT p_type, k, copy, min(p_partkey) AS first, row_number() OVER (PARTITION BY p_type, k ORDER BY min(p_partkey)) AS r FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT p_type, k, text, marks, n, first, n_copies, copies FROM m JOIN c USING (p_type, k)""")
def merging_duplicates(t):
    i, p = F.col("p_partkey"), F.col("p_name")
    text = F.when(i % 4 == 0, F.concat(p, F.lit(" (10 marks)"))).when(i % 4 == 1, F.concat(p, F.lit(" answer in 10 words"))).when(i % 4 == 2, F.concat(F.lit("q1 "), p, F.lit(" q2"))).otherwise(p)
    x = t("part").select("p_partkey", "p_type", p.alias("k"), text.alias("text"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("marks"), (F.col("p_size") % 5).alias("copy"))
    m = M.merged_duplicates(x, ["p_type", "k"], "text", GT.text_quality("text"), "p_partkey", ["marks"]).withColumn("marks", F.coalesce("marks", F.lit(-1)))
    c = M.listed_copies(x, ["p_type", "k"], "copy", ["p_partkey"], 3)
    return m.join(c, ["p_type", "k"]).withColumn("copies", F.array_join(F.col("copies").cast("array<string>"), ","))


@query("""SELECT conv_id, array_to_string(flatten(list(string_split(role, 's') ORDER BY turn)), '|') AS parts FROM conversations GROUP BY conv_id""")
def merging_concatenated(t):
    c = t("conversations").withColumn("parts", F.split("role", "s"))
    return M.concatenated(c, "conv_id", ["parts"], "turn").withColumn("parts", F.array_join("parts", "|"))


@query("""WITH e AS (SELECT DISTINCT p_partkey, unnest(list_concat(string_split(lower(p_name), ' '), [lower(p_type)])) AS keyword FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY p_partkey) AS r FROM e)
SELECT keyword, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (r <= 12), ',') AS first FROM r GROUP BY keyword""")
def merging_keywords(t):
    p = t("part").withColumn("words", F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"))))
    return M.keyword_index(p, "p_partkey", "words").withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, lang, source, unnest(list_filter(string_split({NORMAL}, ' '), lambda x: length(x) >= 7)) AS concept FROM documents),
c AS (SELECT concept, count(*) AS mentions FROM (SELECT DISTINCT conv_id, turn, unnest(list_filter(string_split({NORMAL}, ' '), lambda x: length(x) >= 7)) AS concept FROM conversations) GROUP BY 1),
k AS (SELECT concept, source, row_number() OVER (PARTITION BY concept ORDER BY source) AS r FROM (SELECT DISTINCT concept, source FROM w))
SELECT concept, count(DISTINCT doc_id) AS documents, coalesce(any_value(mentions), 0) AS mentions, any_value(s) AS subjects FROM w LEFT JOIN c USING (concept) JOIN (SELECT concept, array_to_string(list(source ORDER BY source) FILTER (r <= 3), ',') AS s FROM k GROUP BY 1) USING (concept) GROUP BY concept""")
def merging_concepts(t):
    long = lambda c: F.filter(T.tokens(T.search_normalise(c)), lambda x: F.length(x) >= 7)
    d, c = t("documents").withColumn("concepts", long("text")), t("conversations").withColumn("concepts", long("text"))
    return M.concept_index(d, c, "doc_id", "source", "concepts", 3).withColumn("subjects", F.array_join("subjects", ","))


@query("""SELECT p_brand AS theme, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_type) > 1 AS "cross", count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def merging_themes(t):
    j = t("lineitem").join(t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").withColumnRenamed("p_brand", "theme")
    return M.themes(j, "theme", {"suppliers": "l_suppkey", "orders": "l_orderkey"}, "p_type")


@query("""WITH x AS (SELECT l_suppkey, l_returnflag || l_linestatus AS name, l_linenumber AS rank, CASE WHEN l_quantity > 10 THEN year(l_shipdate) END AS y, l_partkey, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity::BIGINT AS ord FROM lineitem),
a AS (SELECT l_suppkey, name, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(ord), name) AS r FROM x GROUP BY 1, 2), i AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(ord), l_partkey) AS r FROM x GROUP BY 1, 2)
SELECT l_suppkey, min(rank) AS rank, min_by(y, ord) FILTER (y IS NOT NULL) AS year, count(*) AS n, any_value(al) AS aliases, any_value(il) AS ids FROM x JOIN (SELECT l_suppkey, array_to_string(list(name ORDER BY r) FILTER (r <= 12), ',') AS al FROM a GROUP BY 1) USING (l_suppkey)
JOIN (SELECT l_suppkey, array_to_string(list(l_partkey ORDER BY r) FILTER (r <= 12), ',') AS il FROM i GROUP BY 1) USING (l_suppkey) GROUP BY l_suppkey""")
def merging_people(t):
    x = t("lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_quantity") > 10, F.year("l_shipdate")).cast("long").alias("year"), "l_partkey",
        (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")).alias("ord"),
    )
    p = M.people(x, "l_suppkey", "name", "rank", "year", "l_partkey", "ord")
    return p.withColumn("aliases", F.array_join("aliases", ",")).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH a AS (SELECT user_id, event_type AS item, event_id % 7 = 0 AS done, ts AS "at", 1::BIGINT AS "count" FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type, event_id % 5 = 0, ts, 1::BIGINT FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup'))
SELECT user_id, item, bool_or(done) AS done, max("at") AS "at", sum("count")::BIGINT AS "count" FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def merging_once(t):
    e = t("events")
    side = lambda odd, n: e.filter(F.col("event_id") % 2 == odd).select("user_id", F.col("event_type").alias("item"), (F.col("event_id") % n == 0).alias("done"), F.col("ts").alias("at"), F.lit(1).cast("long").alias("count"))
    return M.merged_once(side(0, 7), side(1, 5), e.filter("event_type = 'signup'").select("user_id"), "user_id", ["item"], "done", "at", "count")


@query("""SELECT user_id, event_type, bool_or(value > 20) AS done, max(ts) AS "at", max(event_id % 9) AS "count" FROM events GROUP BY 1, 2""")
def merging_progress_synced(t):
    e = t("events").select("user_id", "event_type", (F.col("value") > 20).alias("done"), F.col("ts").alias("at"), (F.col("event_id") % 9).alias("count"))
    return M.progress(e, ["user_id", "event_type"], "done", "at", "count", syncing=True)


@query("SELECT p_name AS alias, max_by(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY 1")
def merging_aliases(t):
    return M.alias_index(t("part").withColumnRenamed("p_name", "alias").withColumn("ord", F.col("p_partkey")), "alias", "p_partkey", "ord")


@query("""WITH w AS (SELECT p_type, count(DISTINCT p_brand) AS wanted FROM part GROUP BY 1), d AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40),
h AS (SELECT l_suppkey, p_type, count(*) AS have FROM d JOIN (SELECT DISTINCT p_type, p_brand FROM part) USING (p_brand) GROUP BY 1, 2) SELECT l_suppkey, p_type, floor(100 * have / wanted + 0.5)::INT AS percent FROM h JOIN w USING (p_type)""")
def merging_percent_done(t):
    done = t("lineitem").filter("l_quantity > 40").join(t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("l_suppkey", "p_brand")
    return M.percent_done(t("part").select("p_type", "p_brand"), done, "p_type", "p_brand", "l_suppkey")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def merging_sections(t):
    return M.section_index(t("documents"), "source", "lang")


@query("""WITH g AS (SELECT o_custkey, count(*) AS orders, sum(k)::BIGINT AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_custkey, coalesce(n, 0)::INT AS n FROM g""")
def merging_nested_sizes(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("lines"))
    o = t("orders").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.collect_list(F.struct("lines")).alias("entries"))
    return o.select("o_custkey", M.nested_size(F.col("entries"), "lines").alias("n"))


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey FROM part WHERE p_size < 8), e AS (SELECT name AS k, min(p_partkey) AS v FROM t GROUP BY 1), l AS (SELECT lower(name) AS k, min(p_partkey) AS v FROM t GROUP BY 1)
SELECT p.p_partkey AS id, coalesce(e1.v, e2.v, l1.v, l2.v, -1) AS p_partkey FROM part p LEFT JOIN e e1 ON e1.k = p_name LEFT JOIN e e2 ON e2.k = upper(p_name) LEFT JOIN l l1 ON l1.k = lower(p_name) LEFT JOIN l l2 ON l2.k = lower(upper(p_name))""")
def merging_lookup(t):
    p = t("part")
    table = p.filter("p_size < 8").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey").withColumn("ord", F.col("p_partkey"))
    rows = p.select(F.col("p_partkey").alias("id"), "p_name")
    found = M.lookup(rows, table, [F.col("p_name"), F.upper("p_name")], "name", "p_partkey", "ord")
    return found.select("id", F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"))


INSIDE = """a AS (SELECT DISTINCT lower(p_name) AS k FROM part), b AS (SELECT lower(string_split(p_name, ' ')[2]) || CASE WHEN min(p_partkey) % 2 = 0 THEN '' ELSE ' ' || lower(string_split(p_name, ' ')[1]) END AS name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name
UNION ALL SELECT lower(p_name), min(p_partkey) + 100000 FROM part WHERE p_size > 45 GROUP BY 1), e AS (SELECT k, min(p_partkey) AS v FROM a JOIN b ON k = name GROUP BY 1),
n AS (SELECT k, min(p_partkey) AS v, count(DISTINCT name) AS c FROM a JOIN b ON contains(k, name) OR contains(name, k) WHERE k NOT IN (SELECT k FROM e) GROUP BY 1)"""


def _contained(t, unique: bool):
    p, parts = t("part"), F.split("p_name", " ")
    short = p.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    name = F.lower(F.concat(F.get(parts, F.lit(1)), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.get(parts, F.lit(0))))))
    whole = p.filter("p_size > 45").groupBy(F.lower("p_name").alias("name")).agg((F.min("p_partkey") + 100_000).alias("p_partkey"))
    table = short.select(name.alias("name"), "p_partkey").union(whole).withColumn("ord", F.col("p_partkey"))
    return M.contained_lookup(p.select(F.lower("p_name").alias("k")), table, "k", "name", "p_partkey", "ord", unique)


@query(f"WITH {INSIDE} SELECT k, v AS p_partkey, 'exact' AS stage FROM e UNION ALL SELECT k, v, 'contained' FROM n")
def merging_contained(t):
    return _contained(t, False)


@query(f"WITH {INSIDE} SELECT k, v AS p_partkey, 'exact' AS stage FROM e UNION ALL SELECT k, v, 'contained' FROM n WHERE c = 1")
def merging_contained_once(t):
    return _contained(t, True)


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000), x AS (SELECT o_custkey, a.o_orderkey, l_linenumber, l_quantity, l_partkey, row_number() OVER (PARTITION BY o_custkey, a.o_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM a JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey, l_linenumber, l_quantity, l_partkey, place::INT AS place FROM x WHERE place <= 3""")
def merging_expanded(t):
    accepted = t("orders").filter("o_totalprice > 100000").select("o_custkey", "o_orderkey").distinct()
    answers = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return M.expanded(accepted, answers, "o_orderkey", [F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"], 3).select("o_custkey", "o_orderkey", "l_linenumber", "l_quantity", "l_partkey", "place")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS up, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
c AS (SELECT 's' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS b, 'r' || n_regionkey AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT id AS k, n FROM c UNION ALL SELECT b, n FROM c JOIN s USING (id) UNION ALL SELECT a, n FROM c JOIN s USING (id)), g AS (SELECT k AS id, sum(n)::BIGINT AS n FROM u GROUP BY 1)
SELECT n.id, CASE WHEN p2.label IS NOT NULL THEN p2.label || ' > ' ELSE '' END || CASE WHEN p1.label IS NOT NULL THEN p1.label || ' > ' ELSE '' END || n.label AS path, coalesce(g.n, 0) AS n FROM n LEFT JOIN n p1 ON p1.id = n.up LEFT JOIN n p2 ON p2.id = p1.up LEFT JOIN g ON g.id = n.id""")
def merging_tree(t):
    tag = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    r = t("region").select(tag("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("label"))
    n = t("nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey"), "n_name")
    s = t("supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey"), "s_name")
    counts = t("lineitem").groupBy(tag("s", "l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return M.tree_counts(r.union(n).union(s), counts, "id", "up", "label")


@query("""WITH k AS (SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 > 0)), g AS (SELECT DISTINCT page_id // 2 AS grp FROM k), d AS (SELECT grp, row_number() OVER (ORDER BY grp) AS number FROM g)
SELECT page_id, url, grp, number FROM (SELECT page_id, url, page_id // 2 AS grp FROM k) JOIN d USING (grp)""")
def merging_pruned(t):
    p = t("pages").select("page_id", "url", F.floor(F.col("page_id") / 2).alias("grp"))
    status = t("pages").select("url", (F.col("page_id") % 3 > 0).alias("good"))
    return M.pruned(p, status, "grp", "url", "good").select("page_id", "url", "grp", "number")


@query("""SELECT p.page_id, CASE WHEN starts_with(p.url, 'https://www.') THEN p.url ELSE s.u END AS url FROM pages p LEFT JOIN (SELECT page_id, min('https://cdn/' || page_id) AS u FROM pages WHERE page_id % 2 = 0 GROUP BY 1) s USING (page_id)""")
def merging_published(t):
    sources = t("pages").filter("page_id % 2 = 0").select("page_id", F.concat(F.lit("https://cdn/"), "page_id").alias("url"))
    return M.published_links(t("pages").select("page_id", "url"), sources, "page_id", "url", F.col("url").startswith("https://www."))


@query("SELECT sum(len(regexp_extract_all(c_name || ' ' || c_mktsegment, '[AEIOU]')))::BIGINT AS n FROM customer")
def merging_leaks(t):
    return M.leaks(t("customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("v")), "[AEIOU]")


@query("""WITH w AS (SELECT unnest(list_filter(string_split(lower(p_name), ' '), lambda x: true)) AS tag FROM part) SELECT tag, n FROM (SELECT tag, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, tag LIMIT 5)""")
def merging_tag_counts(t):
    return M.tag_counts(t("part").withColumn("w", F.split(F.lower("p_name"), " ")), "w", 5)


@query("""SELECT l.lang, coalesce(quality || '', 'unknown') AS quality, count(*) AS n, count(embedding) AS with_vector, count(*) FILTER (toxic = 1) AS toxic FROM documents l LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2""")
def merging_status(t):
    j = t("documents").join(t("labels"), "doc_id", "left").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return j.groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality")).agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""SELECT p_partkey, array_to_string(list_filter([lower(p_type), 'ring', 'RED'], lambda x: list_contains(string_split(lower(p_name), ' '), lower(x)) OR x = lower(p_type) AND p_size % 2 = 0), ',') AS both FROM part""")
def merging_intersection(t):
    words = F.concat(F.split(F.lower("p_name"), " "), F.when(F.col("p_size") % 2 == 0, F.array(F.lower("p_type"))).otherwise(F.array().cast("array<string>")))
    return t("part").select("p_partkey", F.array_join(R.common(F.array(F.lower("p_type"), F.lit("ring"), F.lit("RED")), words), ",").alias("both"))


PROMPTS = """l AS (SELECT p_partkey AS a, trim(lower(p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END)) AS n, string_split(lower(p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END), ' ') AS w, [lower(p_brand), lower(p_type)] AS th FROM part WHERE p_partkey % 50 = 0),
r AS (SELECT p_partkey AS b, lower(CASE WHEN p_size % 4 = 0 THEN p_type || ' ' || p_name WHEN p_size % 4 = 1 THEN p_name || ' ' || p_brand ELSE p_name END) AS n, string_split(lower(CASE WHEN p_size % 4 = 0 THEN p_type || ' ' || p_name WHEN p_size % 4 = 1 THEN p_name || ' ' || p_brand ELSE p_name END), ' ') AS w, [lower(p_brand), lower(p_type)] AS th FROM part),
s1 AS (SELECT a, b FROM l JOIN r USING (n)), l2 AS (SELECT * FROM l WHERE a NOT IN (SELECT a FROM s1)),
s2 AS (SELECT a, b FROM l2 JOIN r ON list_sort(list_distinct(l2.w)) = list_sort(list_distinct(r.w)) AND len(list_distinct(r.w)) >= 2), l3 AS (SELECT * FROM l2 WHERE a NOT IN (SELECT a FROM s2)),
h AS (SELECT DISTINCT b, unnest(w) AS token FROM r), df AS (SELECT token, count(*) AS df FROM h GROUP BY 1), k AS (SELECT a, token, df, row_number() OVER (PARTITION BY a ORDER BY df, token) AS r FROM (SELECT DISTINCT a, unnest(w) AS token FROM l3) JOIN df USING (token)),
p AS (SELECT DISTINCT a, b FROM k JOIN h USING (token) WHERE df * 10 <= (SELECT count(*) FROM r) OR r = 1),
x AS (SELECT a, b, len(list_intersect(l3.w, r.w)) AS sh, len(list_distinct(l3.w)) AS na, len(list_distinct(list_concat(l3.w, r.w))) AS nu, len(list_intersect(l3.th, r.th)) AS bt FROM p JOIN l3 USING (a) JOIN r USING (b)),
y AS (SELECT *, sh / na AS cv, sh / nu AS jc, bt / 2 AS te, least(0.94, sh / na * 0.68 + sh / nu * 0.22 + bt / 2 * 0.1) AS cf FROM x),
z AS (SELECT *, greatest(cf, cv, jc, te) AS v, CASE WHEN sh >= 3 AND cv >= 0.5 THEN 'strong' WHEN sh >= 2 AND cv >= 0.24 AND cf >= 0.22 THEN 'topic-match' WHEN sh >= 1 AND te >= 0.34 AND cv >= 0.12 AND cf >= 0.24 THEN 'loose-topic-match' END AS type FROM y),
o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(v + least(0.12, sh * 0.03), 9) DESC, b) AS r FROM z WHERE type IS NOT NULL)"""


@query(f"""WITH {PROMPTS} SELECT a, b, 'exact' AS stage, 1.0::DOUBLE AS confidence, 'direct' AS type FROM s1 UNION ALL SELECT a, b, 'signature', 0.98, 'direct' FROM s2 UNION ALL SELECT a, b, 'scored', round(v, 6), type FROM o WHERE r <= 18""")
def merging_staged_matches(t):
    p, size = t("part"), F.col("p_size")
    theme = F.array(F.lower("p_brand"), F.lower("p_type")).alias("theme")
    left = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("a"), F.lower(F.concat("p_name", F.when(size % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""))).alias("n"), theme)
    said = F.when(size % 4 == 0, F.concat("p_type", F.lit(" "), "p_name")).when(size % 4 == 1, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.col("p_name"))
    right = p.select(F.col("p_partkey").alias("b"), F.lower(said).alias("n"), theme)
    words = lambda df: df.withColumn("w", F.split("n", " "))
    return M.staged_matches(words(left), words(right), "a", "b", "n", "w", "theme").withColumn("confidence", F.round("confidence", 6))


BOOST = f"""{IDF}, ask AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, token) AS r FROM qt JOIN idf USING (token)),
pair AS (SELECT DISTINCT item_id, doc_id FROM ask JOIN dt USING (token) WHERE r <= 10 AND (weight >= 1.65 OR r = 1)),
ls AS (SELECT item_id, count(*) AS nl, sum(weight) AS wl FROM qt JOIN idf USING (token) GROUP BY 1), rs AS (SELECT doc_id, count(*) AS nr, sum(weight) AS wr FROM dt JOIN idf USING (token) GROUP BY 1),
sh AS (SELECT item_id, doc_id, count(*) AS k, sum(weight) AS wk FROM pair JOIN qt USING (item_id) JOIN dt USING (doc_id, token) JOIN idf USING (token) GROUP BY 1, 2),
tp AS (SELECT item_id, list_filter(toks, lambda t: t NOT IN ('thea', 'tion') AND NOT regexp_full_match(t, '[0-9]{{1,2}}')) AS tt FROM q), ds AS (SELECT doc_id, list_distinct(toks) AS dd, doc_id % 2 = 0 AS subject FROM d),
tv AS (SELECT item_id, doc_id, subject, len(list_filter(tt, lambda t: list_contains(dd, t))) AS th, least(8, len(list_filter(list_distinct(tt), lambda t: list_contains(dd, t)))) AS hits, greatest(1, least(greatest(len(tt), 1), greatest(len(dd), 1))) AS den FROM sh JOIN tp USING (item_id) JOIN ds USING (doc_id)),
{_anchors("'thea', 'tion'")}, an AS (SELECT item_id, doc_id, least(8, count(*)) AS na FROM p JOIN dg USING (phrase) GROUP BY 1, 2),
f AS (SELECT item_id, doc_id, subject, k, hits, coalesce(na, 0) AS na, th, th / den AS ov, k / nl AS cv, wk / wl AS hv, greatest(k / nl, k / nr, wk / wl, wk / wr, th / den) AS fl, least(0.99, least(0.99, 0.24 * k / nl + 0.18 * k / nr + 0.15 * k / (nl + nr - k) + 0.24 * wk / wl + 0.09 * wk / wr) + least(0.18, coalesce(na, 0) * 0.07) + least(0.08, hits * 0.025) + CASE WHEN subject THEN 0.04 ELSE 0 END + least(0.14, th / den * 0.14)) AS c
FROM sh JOIN ls USING (item_id) JOIN rs USING (doc_id) JOIN tv USING (item_id, doc_id) LEFT JOIN an USING (item_id, doc_id))"""


CLASS = """CASE WHEN c >= 0.82 AND k >= 5 AND cv >= 0.72 AND hv >= 0.76 THEN 'strong' WHEN c >= 0.68 AND subject AND na >= 1 AND hits >= 1 AND hv >= 0.36 THEN 'strong' WHEN subject AND ov >= 0.3 AND (k >= 2 OR na >= 1 OR hv >= 0.18) THEN 'topic-match'
WHEN subject AND fl >= 0.3 AND th >= 1 AND (k >= 1 OR hits >= 2) THEN 'loose-topic-match' ELSE 'none' END"""


def _corpus_links(t):
    d = t("documents").select("doc_id", T.link_tokens("text", STOP).alias("toks"))
    q = t("benchmark").select("item_id", T.link_tokens("text", STOP).alias("toks"))
    return J.corpus_links(q, d, "item_id", "doc_id", "toks", ["thea", "tion"], F.col("doc_id") % 2 == 0)


@query(f"""WITH {BOOST}, h AS (SELECT *, {CLASS} AS class FROM f) SELECT item_id, doc_id, rank::INT AS rank, round(c, 6) AS confidence, hits::INT AS hits, na::INT AS anchors, class FROM (
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM h WHERE class <> 'none') WHERE rank <= 18""")
def merging_corpus_links(t):
    return _corpus_links(t)[0].select("item_id", "doc_id", "rank", F.round("confidence", 6).alias("confidence"), "hits", "anchors", "class")


@query(f"""WITH {BOOST}, h AS (SELECT *, {CLASS} AS class FROM f) SELECT item_id, doc_id, rank::INT AS rank, round(c, 6) AS confidence FROM (
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM h WHERE class = 'none' AND c >= 0.24) WHERE rank <= 6""")
def merging_corpus_review(t):
    return _corpus_links(t)[1].select("item_id", "doc_id", "rank", F.round("confidence", 6).alias("confidence"))
