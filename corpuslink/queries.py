"""Registered queries of the library over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tags as TG
from .functions import text as T
from .operators import grouping as G
from .operators import linking as L
from .operators import people as P
from .operators import placement as PL
from .operators import rounds as RO
from .operators import search as S
from .sources import trees as TR
from .streaming import calendar as CAL
from .streaming import counters as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STOP = ["the", "and", "for", "with", "that", "this", "was", "are"]
DIRECTIVES = ["discuss", "explain", "examine", "the", "und"]
TERMS = ["the", "tion", "ing"]


def query(sql: str | None = None):
    """Register a query under its name; its function takes a reader of tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NORMAL = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
TOKS = f"list_filter(string_split({NORMAL}, ' '), lambda t: t <> '')"
_NOTE = r"\b[0-9]{1,3}\s*marks?"
_STEPS = [
    (rf"\([^)]*{_NOTE}[^)]*\)|\[[^\]]*{_NOTE}[^\]]*\]", "g"), (rf"{_NOTE}(?:\s*/\s*[0-9]+\s*words?)?\b", "g"), (r"^\s*q\.?\s*[0-9]{0,2}\s*[a-e]?\s*[.)\]:-]?\s*", ""),
    (r"^\s*qa?\s*[.)\]:-]?\s*", ""), (r"^\s*[0-9]{1,2}\s*[.)\]:-]\s*", ""),
]
QNORMAL = "lower(coalesce(text, ''))"
for _pattern, _flags in _STEPS:
    QNORMAL = f"regexp_replace({QNORMAL}, '{_pattern}', '', '{_flags}')"
QNORMAL = f"trim(regexp_replace(replace({QNORMAL}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
STEM = (
    "CASE WHEN t LIKE '%isation' THEN regexp_replace(t, 'isation$', 'ization') WHEN t LIKE '%isations' THEN regexp_replace(t, 'isations$', 'ization') WHEN t LIKE '%analys' THEN t || 'i' "
    "WHEN t = 'nineteenth' THEN '19th' WHEN t = 'twentieth' THEN '20th' WHEN t LIKE '%ies' AND length(t) > 6 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%ing' AND length(t) > 7 THEN regexp_replace(t, 'ing$', '') "
    "WHEN t LIKE '%ed' AND length(t) > 6 THEN regexp_replace(t, 'ed$', '') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 5 THEN regexp_replace(t, 's$', '') ELSE t END"
)
STOPS = ", ".join(f"'{w}'" for w in STOP)
LTOKS = (
    f"list_filter(list_transform(list_filter(string_split({QNORMAL}, ' '), lambda x: x <> ''), lambda t: {STEM}), "
    f"lambda t: (length(t) >= 3 OR regexp_full_match(t, '[0-9]{{2,4}}')) AND t NOT IN ({STOPS}))"
)


# ---- text functions ----


@query(f"SELECT doc_id, {NORMAL} AS normal, md5(array_to_string({TOKS}, '|')) AS toks FROM documents")
def text_search_normalise(t):
    n = T.search_normalise("text")
    return t("documents").select("doc_id", n.alias("normal"), F.md5(F.array_join(T.tokens(n), "|").cast("binary")).alias("toks"))


@query(f"SELECT doc_id, {QNORMAL} AS normal, array_to_string({LTOKS}, ' ') AS toks, array_to_string(list_sort(list_distinct({LTOKS})), ' ') AS sig FROM documents")
def text_link_tokens(t):
    toks = T.link_tokens("text", STOP)
    return t("documents").select("doc_id", T.question_normalise("text").alias("normal"), F.array_join(toks, " ").alias("toks"), T.signature(toks).alias("sig"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS tight,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS wide FROM documents""")
def text_fuzzy_keys(t):
    return t("documents").select("doc_id", T.fuzzy_key("text").alias("tight"), T.fuzzy_key("text", " ").alias("wide"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', ' ', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' ', 'g'), '[+]?[0-9][0-9 ()-]{8,}[0-9]', ' ', 'g'), '[ \t]+', ' ', 'g')) AS safe FROM documents""")
def text_scrub(t):
    return t("documents").select("doc_id", T.scrub("text").alias("safe"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
  '(?i)<br */?>|</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS body FROM pages""")
def text_from_html(t):
    return t("pages").select("page_id", T.html_to_text("html").alias("body"))


@query("""SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), ''), 'q') AS slug,
  'doc_' || substr(sha256(lang || '|' || source || '|' || doc_id), 1, 12) AS sid, regexp_matches(lower(text), 'the') AS has FROM documents""")
def text_slug_and_id(t):
    return t("documents").select("doc_id", T.slug("text").alias("slug"), T.stable_id("doc_", 12, "lang", "source", "doc_id").alias("sid"), F.lower("text").contains("the").alias("has"))


@query("""WITH x AS (SELECT doc_id, text, substr(text, 1, 200) AS h FROM documents), y AS (SELECT *, length(h) - (instr(reverse(h), ' ')) AS last FROM x)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(CASE WHEN instr(h, ' ') > 0 AND last > 100 THEN substr(h, 1, last) ELSE h END) || '...' END AS clipped,
len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS words FROM y""")
def text_clip_and_count(t):
    return t("documents").select("doc_id", T.clip("text", 200).alias("clipped"), T.word_count("text").alias("words"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'und') THEN 'und' END AS directive,
CASE WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'legal' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'numeric' WHEN regexp_matches(text, '[éèçñüöä]') THEN 'accented' ELSE 'Other' END AS class FROM documents""")
def text_classify(t):
    rules = [("legal", "(?i)licen[sc]e|copyright"), ("numeric", "[0-9]{4,}"), ("accented", "[éèçñüöä]")]
    return t("documents").select("doc_id", T.first_contained("text", ["license", "the", "und"]).alias("directive"), T.classify("text", rules, "Other").alias("class"))


@query("""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, 'th')) AS a, len(regexp_extract_all(text, 'ch')) AS b, len(regexp_extract_all(text, 'que')) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'th' WHEN b >= c THEN 'ch' ELSE 'que' END AS class FROM h""")
def text_most_hits(t):
    return t("documents").select("doc_id", T.most_hits("text", [("th", "th"), ("ch", "ch"), ("que", "que")], "none").alias("class"))


@query(r"""WITH x AS (SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || doc_id % 40 || '. '), ', ', CASE WHEN doc_id % 3 = 0 THEN ' 15 marks,' || chr(10) ELSE ', ' END) AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 28 AND 320
AND (regexp_matches(lower(x), '\b[0-9]{1,3}\s*marks?\b') OR (regexp_matches(lower(x), '^(?:(?:q\.?\s*)?[0-9]{1,2}\s*(?:[.)]|\([a-e]\)|[a-e][.)])|\([a-e]\))\s') AND regexp_matches(lower(x), '\b(?:discuss|explain|examine|the|und)\b')))
AND NOT regexp_matches(lower(x), 'quei|thth')) AS l FROM x), k AS (SELECT doc_id, list_transform(l, lambda x: x[1:260]) AS l FROM l),
f AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[:80] AS l FROM k)
SELECT doc_id, len(l)::INT AS n, array_to_string(l, '|') AS lines FROM f""")
def text_question_lines(t):
    """The sentences of a text as numbered lines, and in every third text with marks at commas."""
    k = F.col("doc_id")
    numbered = F.replace(T.text("text"), F.lit(". "), F.concat(F.lit(".\n"), (k % 40).cast("string"), F.lit(". ")))
    d = t("documents").select("doc_id", F.replace(numbered, F.lit(", "), F.when(k % 3 == 0, F.lit(" 15 marks,\n")).otherwise(F.lit(", "))).alias("t"))
    rows = d.withColumn("l", T.question_lines("t", 28, 320, DIRECTIVES, ["quei", "thth"]))
    return rows.select("doc_id", F.size("l").alias("n"), F.array_join("l", "|").alias("lines"))


@query("""SELECT event_id, coalesce(TRY_CAST(regexp_extract(event_type || '', '^\\s*([+-]?[0-9]{1,9})', 1) AS INT), -1) AS bad, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS n,
floor(value * 1000 + 0.5) / 1000.0 AS rounded, (ts::DATE - CAST(dayofweek(ts) AS INT))::DATE AS week, ts::DATE AS day FROM events""")
def fields_numbers_and_dates(t):
    d = F.to_date("ts")
    return t("events").select(
        "event_id", F.coalesce(T.lenient_int("event_type"), F.lit(-1)).alias("bad"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("n"),
        T.round_half_up(F.col("value"), 3).alias("rounded"), F.date_sub(d, F.dayofweek(d) - 1).alias("week"), d.alias("day"),
    )


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '#.*$', ''), '\?.*$', ''), '^https?://(www\.|m\.)?', '') AS canonical,
regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, starts_with(url, 'https://') AND NOT contains(url, '?') AND NOT contains(url, '#') AS allowed FROM pages""")
def fields_urls(t):
    u = F.lower("url")
    canonical = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"\?.*$", ""), r"^https?://(www\.|m\.)?", "")
    ok = F.col("url").startswith("https://") & ~F.col("url").contains("?") & ~F.col("url").contains("#")
    return t("pages").select("page_id", canonical.alias("canonical"), F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), ok.alias("allowed"))


# ---- linking ----

IDF = f"""d AS (SELECT doc_id, {LTOKS} AS toks FROM documents), q AS (SELECT item_id, {LTOKS} AS toks FROM benchmark),
dt AS (SELECT DISTINCT doc_id, unnest(toks) AS token FROM d), qt AS (SELECT DISTINCT item_id, unnest(toks) AS token FROM q),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)) + 1 AS weight FROM dt GROUP BY token)"""


@query(f"WITH {IDF} SELECT token, df, round(weight, 6) AS weight FROM idf")
def linking_idf(t):
    d = t("documents").select("doc_id", T.link_token_set("text", STOP).alias("toks"))
    return L.idf(d, "toks").select("token", "df", F.round("weight", 6).alias("weight"))


@query(f"""WITH {IDF}, ask AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, token) AS r FROM qt JOIN idf USING (token)),
pair AS (SELECT DISTINCT item_id, doc_id FROM ask JOIN dt USING (token) WHERE r <= 10 AND (weight >= 1.65 OR r = 1)),
ls AS (SELECT item_id, count(*) AS nl, sum(weight) AS wl FROM qt JOIN idf USING (token) GROUP BY 1), rs AS (SELECT doc_id, count(*) AS nr, sum(weight) AS wr FROM dt JOIN idf USING (token) GROUP BY 1),
sh AS (SELECT item_id, doc_id, count(*) AS k, sum(weight) AS wk FROM pair JOIN qt USING (item_id) JOIN dt USING (doc_id, token) JOIN idf USING (token) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, k / nl AS cover, least(0.99, 0.24 * k / nl + 0.18 * k / nr + 0.15 * k / (nl + nr - k) + 0.24 * wk / wl + 0.09 * wk / wr) AS c FROM sh JOIN ls USING (item_id) JOIN rs USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, rank::INT AS rank, round(cover, 6) AS cover, round(c, 6) AS confidence, CASE WHEN cover >= 0.72 THEN 'strong' WHEN cover >= 0.3 THEN 'topic-match' ELSE 'none' END AS class FROM rk WHERE rank <= 5""")
def linking_candidates(t):
    d = RO.settled(t("documents").select("doc_id", T.link_token_set("text", STOP).alias("toks")))
    q = t("benchmark").select("item_id", T.link_token_set("text", STOP).alias("toks"))
    weights = L.idf(d, "toks").select("token", "weight")
    scores = L.linked(q, d, weights, "item_id", "doc_id", "toks")
    top = G.top_per_group(scores, ["item_id"], [F.desc(F.round("confidence", 9)), "doc_id"], 5)
    return top.select("item_id", "doc_id", "rank", F.round("cover", 6).alias("cover"), F.round("confidence", 6).alias("confidence"), L.classed(F.col("cover")).alias("class"))


def _anchors(noise: str) -> str:
    """SQL of the anchor phrases ``p`` of items and the phrases ``dg`` of documents; ``noise``: quoted tokens."""
    return f"""gram AS (SELECT item_id, s, i, toks[i:i + s - 1] AS g FROM (SELECT item_id, toks, s, unnest(range(1, len(toks) - s + 2)) AS i FROM q, (VALUES (3), (2)) z(s))),
gt AS (SELECT item_id, s, i, array_to_string(g, ' ') AS phrase, unnest(g) AS token FROM gram),
gs AS (SELECT item_id, s, i, phrase, avg(coalesce(weight, 1.0)) AS w, bool_or(length(token) >= 8) AS long,
bool_or(regexp_full_match(token, '[0-9]{{2,4}}') OR (token NOT IN ({noise}) AND (length(token) >= 5 OR coalesce(weight, 1.0) >= 2.4))) AS specific FROM gt LEFT JOIN idf USING (token) GROUP BY ALL),
p AS (SELECT item_id, phrase, min((3 - s) * 10000000 + i) AS ord FROM gs WHERE specific AND (w >= 2.2 OR long) GROUP BY 1, 2),
dg AS (SELECT DISTINCT doc_id, array_to_string(toks[i:i + s - 1], ' ') AS phrase FROM (SELECT doc_id, toks, s, unnest(range(1, len(toks) - s + 2)) AS i FROM d, (VALUES (3), (2)) z(s)))"""


@query(f"""WITH {IDF}, {_anchors("'thea'")}
SELECT item_id, doc_id, array_to_string(list(phrase ORDER BY ord)[:8], '|') AS anchors FROM p JOIN dg USING (phrase) GROUP BY 1, 2""")
def linking_anchors(t):
    d = t("documents").select("doc_id", T.link_tokens("text", STOP).alias("toks"))
    q = t("benchmark").select("item_id", T.link_tokens("text", STOP).alias("toks"))
    weights = L.idf(d, "toks").select("token", "weight")
    return L.strong_anchors(q, d, weights, "item_id", "doc_id", "toks", ["thea"]).select("item_id", "doc_id", F.array_join("anchors", "|").alias("anchors"))


@query(f"WITH n AS (SELECT doc_id, {NORMAL} AS k FROM documents) SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM n a JOIN (SELECT k, min(doc_id) AS doc_id FROM n WHERE k <> '' GROUP BY k) b USING (k) WHERE a.doc_id <> b.doc_id")
def linking_exact(t):
    normal = T.search_normalise("text")  # texts meet by a digest of 128 bits
    n = t("documents").filter(normal != "").select("doc_id", F.md5(normal.cast("binary")).alias("k"))
    first = n.groupBy("k").agg(F.min("doc_id").alias("right_id"))
    return L.exact_links(n, first, "k").filter("doc_id != right_id").select(F.col("doc_id").alias("left_id"), "right_id")


@query(f"""WITH v AS (SELECT DISTINCT unnest({TOKS}) AS token FROM documents), q AS (SELECT DISTINCT unnest({TOKS}) AS term FROM benchmark)
SELECT term, token FROM q JOIN v ON term = token OR (contains(term, token) AND length(token) >= 4) OR (contains(token, term) AND length(term) >= 4)
OR levenshtein(term, token) <= CASE WHEN greatest(length(term), length(token)) <= 5 THEN 1 ELSE 2 END""")
def linking_vocabulary(t):
    v = t("documents").select(F.explode(T.tokens(T.search_normalise("text"))).alias("token")).distinct()
    q = t("benchmark").select(F.explode(T.tokens(T.search_normalise("text"))).alias("term")).distinct()
    return L.vocabulary_join(q, v, "term", "token")


@query("SELECT o_orderkey, c.c_name, n.n_name, r.r_name FROM orders JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE o_totalprice > 1000")
def joins_hierarchy(t):
    o = t("orders").filter("o_totalprice > 1000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = t("nation").withColumnRenamed("n_nationkey", "c_nationkey").join(t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return o.join(t("customer"), "c_custkey").join(n, "c_nationkey").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT doc_id, coalesce(l.quality, h.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, min(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source) h USING (source)")
def joins_fallback(t):
    d, lab = t("documents").select("doc_id", "source"), t("labels").select("doc_id", "quality", F.lit(True).alias("has"))
    h = d.join(lab, "doc_id").groupBy("source").agg(F.min("quality").alias("fallback"))
    return d.join(lab, "doc_id", "left").join(h, "source", "left").select("doc_id", F.coalesce("quality", "fallback", F.lit(-1)).alias("quality"), F.col("has").isNotNull().alias("labelled"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def joins_anti(t):
    return t("customer").join(t("orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def joins_semi(t):
    return t("part").join(t("lineitem").filter("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def joins_edges(t):
    return t("lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


# ---- grouping and rollups ----


@query(f"SELECT {NORMAL} AS group_key, min_by(lang, doc_id) AS lang, min_by(text, doc_id) AS text, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n FROM documents GROUP BY 1")
def grouping_by_key(t):
    g = G.grouped(t("documents"), T.search_normalise("text"), "doc_id", ["lang", "text"], "source")
    return g.select("group_key", "lang", "text", F.array_join("source_set", ",").alias("sources"), "n")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders)
SELECT count(*) FILTER (best IS NULL OR o_totalprice > best) AS kept_moves, count(*) FILTER (best IS NOT NULL) AS reviews, o_custkey FROM x GROUP BY o_custkey""")
def grouping_running_best(t):
    o = t("orders")
    lost = G.running_best(o, "o_custkey", "o_totalprice", "o_orderkey").withColumn("moved", (F.col("lost") != F.col("o_orderkey")).cast("long"))
    per = lost.groupBy("o_custkey").agg(F.count("*").alias("reviews"), F.sum("moved").alias("moved"))
    return o.select("o_custkey").distinct().join(per, "o_custkey", "left").select((F.coalesce("moved", F.lit(0)) + 1).alias("kept_moves"), F.coalesce("reviews", F.lit(0)).alias("reviews"), "o_custkey")


@query("""WITH x AS (SELECT *, max({'p': o_totalprice, 'o': -o_orderkey}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders),
y AS (SELECT o_custkey, o_orderkey, -m.o AS keeper, lag(-m.o) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n FROM x)
SELECT o_custkey, CASE WHEN keeper = o_orderkey THEN before ELSE o_orderkey END AS lost, keeper, n FROM y WHERE keeper <> o_orderkey OR before IS NOT NULL""")
def grouping_review_rows(t):
    return G.running_best(t("orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "lost", "keeper", "n")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS signup FROM events")
def grouping_carried(t):
    return G.carried(t("events"), "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "signup").select("event_id", F.coalesce("signup", F.lit(-1)).alias("signup"))


@query("SELECT event_id, CASE WHEN n = 1 THEN user_id::VARCHAR ELSE user_id || '-' || n END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def grouping_suffixed(t):
    return G.suffixed(t("events"), "user_id", "event_id", "uid").select("event_id", "uid")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS new_id FROM events WHERE event_type <> 'error'")
def grouping_dense_ids(t):
    return G.dense_ids(t("events").filter("event_type != 'error'"), "event_id", "new_id").select("event_id", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def grouping_top_n(t):
    return G.top_per_group(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, {'n': n, 's': -seen}) AS event_type, max(n) AS votes FROM c GROUP BY 1""")
def grouping_votes(t):
    return G.votes(t("events"), "user_id", "event_type", "event_id")


@query("""SELECT doc_id, text, source_rank::INT AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_rank) AS r FROM (
SELECT d.doc_id, 'labelled' AS text, 0 AS source_rank FROM documents d JOIN labels USING (doc_id) UNION ALL SELECT doc_id, lang, 1 FROM documents)) WHERE r = 1""")
def sets_ordered_union(t):
    a = t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id", F.lit("labelled").alias("text"))
    return G.ordered_union(a, t("documents").select("doc_id", F.col("lang").alias("text")), "doc_id", "text")


@query("SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 1000) AS long_docs, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL")
def rollup_counters(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_docs"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("""SELECT p_brand AS theme, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_type) > 1 AS cross_type, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def rollup_themes(t):
    j = t("lineitem").join(t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return j.groupBy(F.col("p_brand").alias("theme")).agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"), (F.count_distinct("p_type") > 1).alias("cross_type"), F.count("*").alias("n")
    )


@query("""SELECT c_mktsegment AS name, count(*) AS n_people, min(c_acctbal) AS least, min_by(c_name, c_custkey) AS first_name, array_to_string(list_sort(list_distinct(list(c_nationkey)))[:12], ',') AS nations
FROM customer GROUP BY 1""")
def rollup_entities(t):
    c = t("customer").withColumnRenamed("c_mktsegment", "name")
    sums = c.groupBy("name").agg(F.count("*").alias("n_people"), F.min("c_acctbal").alias("least"), F.min_by("c_name", "c_custkey").alias("first_name"))
    nations = G.top_per_group(c.select("name", "c_nationkey").distinct(), ["name"], ["c_nationkey"], 12, "r").groupBy("name").agg(F.array_sort(F.collect_list("c_nationkey")).alias("nations"))
    return sums.join(nations, "name").withColumn("nations", F.array_join(F.col("nations").cast("array<string>"), ","))


@query("""SELECT l_partkey, l_suppkey, count(*) AS n, array_to_string(list_sort(list(l_orderkey))[:8], ',') AS examples FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def rollup_review_queue(t):
    keys, rows = ["l_partkey", "l_suppkey"], t("lineitem")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("l_orderkey"))
    first = rows.filter("l_orderkey is not null").select(*keys, "l_orderkey").withColumn("r", place).filter("r <= 8")  # all that a list holds
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("l_orderkey", F.lit(None).cast("long"))
    both = counts.unionByName(first.select(*keys, F.lit(0).cast("long").alias("n"), F.col("l_orderkey").cast("long")))
    g = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("l_orderkey")).cast("array<string>"), ",").alias("examples"))
    return g.filter("n > 1")


@query("""SELECT facet, value, n FROM (SELECT 'lang' AS facet, lang AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY lang) WHERE r <= 3
UNION ALL SELECT facet, value, n FROM (SELECT 'source', source, count(*), row_number() OVER (ORDER BY count(*) DESC, source) FROM documents GROUP BY source) x(facet, value, n, r) WHERE r <= 10""")
def search_facets(t):
    return S.facets(t("documents"), {"lang": 3, "source": 10})


# ---- search ----


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def search_page(t):
    return S.page(t("documents").filter("lang = 'en'").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 40, 20)


@query(f"""WITH d AS (SELECT doc_id, {TOKS} AS toks FROM documents), s AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM s WHERE term IN ('the', 'tion', 'ing') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
a AS (SELECT count(*) AS total, avg(len(toks)) AS al FROM d)
SELECT doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))), 6) AS score FROM tf JOIN df USING (term), a GROUP BY 1""")
def search_bm25(t):
    d = t("documents").select("doc_id", T.tokens(T.search_normalise("text")).alias("toks"))
    return S.bm25(d, "doc_id", "toks", TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, n_chars, {NORMAL} AS hay, {TOKS} AS toks FROM documents)
SELECT doc_id, round(0.44 * len(list_filter(['the', 'tion', 'ing'], lambda x: list_contains(toks, x))) / 3 + CASE WHEN contains(hay, 'the tion ing') THEN 0.16 ELSE 0 END
+ 0.22 * len(list_intersect(['the', 'tion', 'ing'], toks)) / greatest(len(list_distinct(list_concat(['the', 'tion', 'ing'], toks))), 1) + 0.14 * least(1.0, n_chars / 5000), 6) AS score FROM d""")
def search_spine(t):
    n = T.search_normalise("text")
    d = t("documents").select("doc_id", "n_chars", n.alias("hay"), T.tokens(n).alias("toks"))
    authority = 0.14 * F.least(F.lit(1.0), F.col("n_chars") / 5000)
    return d.select("doc_id", F.round(S.spine_score(TERMS, F.col("hay"), F.col("toks"), authority), 6).alias("score"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
/ (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 25""")
def search_vectors(t):
    e = t("embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    s = e.join(F.broadcast(q)).select("vec_id", S.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(25).select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT o_orderkey, round(0.5 * least(1.0, o_totalprice / 100000) + 0.5 * least(1.0, (900 + floor(13 * (o_orderkey % 100) + 0.5)) / 2200), 6) AS score FROM orders""")
def search_default_rank(t):
    elo = 900 + F.floor(13 * (F.col("o_orderkey") % 100) + 0.5)
    return t("orders").select("o_orderkey", F.round(0.5 * F.least(F.lit(1.0), F.col("o_totalprice") / 100000) + 0.5 * F.least(F.lit(1.0), elo / 2200), 6).alias("score"))


# ---- streams' batch twins ----


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits FROM events GROUP BY 1, 2")
def stream_window_hits(t):
    return C.window_hits(t("events"), ["user_id"], width="1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_id, s::BIGINT AS window_start, hit::INT AS hit, hit <= 2 AS ok, greatest(0, 2 - hit)::INT AS remaining, (s + 86400)::BIGINT AS reset_at FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS hit FROM (SELECT *, floor(floor(epoch(ts)) / 86400) * 86400 AS s FROM events))""")
def stream_quota_flags(t):
    return C.quota_flags(t("events"), ["user_id"], "event_id", 2, seconds=86400)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, event_id, i, c, reset) AS (SELECT user_id, event_id, i, 1, at_ + 86400 FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, CASE WHEN at_ >= reset THEN 1 ELSE c + 1 END, CASE WHEN at_ >= reset THEN at_ + 86400 ELSE reset END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, c <= 3 AS ok FROM s""")
def stream_anchored_quota(t):
    return C.anchored_quota(t("events"), "user_id", "event_id", 3, 86400.0)


@query("SELECT user_id, ts::DATE AS day, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def stream_daily_activity(t):
    return C.daily_activity(t("events"), "user_id", {"click": 1, "view": 2})


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def stream_upsert(t):
    e = t("events").select("user_id", "event_type", "event_id", "value", "ts")
    half = F.col("event_id") % 2 == 0
    return C.upsert(e.filter(half), e.filter(~half), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def stream_unseen(t):
    return C.unseen(t("pages"), t("pages").filter("page_id % 3 = 0"), "url")


@query("""SELECT user_id, coalesce(b.n, a.n) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a
FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)""")
def stream_reconciled(t):
    one = lambda k: t("events").filter(F.col("event_type") == k).groupBy("user_id").agg(F.count("*").alias("n"))
    return C.reconciled(one("view"), one("click"), ["user_id"], "n")


# ---- people, tags, documents of unknown shape, calendars ----

NOISE = ["test", "series", "copy", "pdf", "the"]
NAME_KEY = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\b(?:air|rank)\s*[0-9]+\b', ' ', 'g'), '\b[0-9]{4}\b', ' ', 'g'), "
    r"'(?i)\b(?:test|series|copy|pdf|the)\b', ' ', 'g'), '[^A-Za-z .''-]', ' ', 'g'), ' +', ' ', 'g')))"
)
CONCEPTS = ["the", "tion", "une", "der", "on the", "is and", "les", "und die"]
ALIASES = {"eau": "French", "ment": "French", "sch": "German", "the ": "English", "ción": "Spanish", "tion": "Abstract"}
CATEGORY = {"en": ["Latin", "English"], "de": ["Latin", "German"]}
KINDS = [("year", r"(?<![A-Za-z0-9_])[12][0-9]{3}(?![A-Za-z0-9_])"), ("mail", r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+")]


@query(f"SELECT doc_id, {NAME_KEY} AS name_key, regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g') AS letters FROM documents")
def people_name_keys(t):
    return t("documents").select("doc_id", P.name_key("text", NOISE).alias("name_key"), P.letters_key("text").alias("letters"))


@query("""WITH v AS (SELECT l_partkey, l_returnflag || l_linestatus AS name, sum(CASE WHEN l_linestatus = 'F' THEN 8 ELSE 5 END + CASE WHEN l_quantity > 25 THEN 2 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS score, count(*) AS hits FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, name, score, hits FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, hits DESC, name) AS r FROM v) WHERE r = 1""")
def people_source_votes(t):
    weight = F.when(F.col("l_linestatus") == "F", 8).otherwise(5) + F.when(F.col("l_quantity") > 25, 2).otherwise(0) + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return P.weighted_votes(t("lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus")), "l_partkey", "label", weight, "name")


@query("""WITH e AS (SELECT *, nullif(event_id % 5, 0) AS rank, nullif(event_id % 3, 0) AS year FROM events), s AS (
SELECT user_id, rank, year, event_type AS source, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS src, event_id FROM e WHERE event_type IN ('signup', 'click', 'view') AND (rank IS NOT NULL OR year IS NOT NULL))
SELECT user_id, coalesce(rank, -1) AS rank, coalesce(year, -1) AS year, source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank IS NULL, src, event_id) AS r FROM s) WHERE r = 1""")
def people_lookup(t):
    e = t("events").withColumn("rank", F.col("event_id") % 5).withColumn("year", F.col("event_id") % 3)
    found = P.first_or_ranked([(k, e.filter(F.col("event_type") == k)) for k in ("signup", "click", "view")], "user_id", "event_id", "rank", "year")
    return found.select("user_id", F.coalesce("rank", F.lit(-1)).alias("rank"), F.coalesce("year", F.lit(-1)).alias("year"), "source")


@query(r"""SELECT doc_id, array_to_string(list_filter(['und die', 'on the', 'is and', 'tion', 'the', 'une', 'der', 'les'], lambda c:
CASE WHEN contains(c, ' ') THEN contains(lower(text), c) ELSE regexp_matches(lower(text), '\b' || c || '\b') END)[:3], '|') AS concepts FROM documents""")
def tags_concepts(t):
    return t("documents").select("doc_id", F.array_join(TG.concepts("text", CONCEPTS, 3), "|").alias("concepts"))


@query("""WITH x AS (SELECT doc_id, list_concat(list_transform(list_filter([['eau', 'French'], ['ment', 'French'], ['sch', 'German'], ['the ', 'English'], ['ción', 'Spanish'], ['tion', 'Abstract']], lambda a: contains(lower(text), a[1])), lambda a: a[2]),
CASE lang WHEN 'en' THEN ['Latin', 'English'] WHEN 'de' THEN ['Latin', 'German'] ELSE [] END) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[:3], '|') AS tags FROM x""")
def tags_aliases(t):
    return t("documents").select("doc_id", F.array_join(TG.alias_tags("text", ALIASES, "lang", CATEGORY, 3), "|").alias("tags"))


@query(r"""SELECT doc_id, 'year' AS kind, unnest(list_distinct(regexp_extract_all(text, '\b[12][0-9]{3}\b'))) AS value FROM documents
UNION ALL SELECT doc_id, 'mail', unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+'))) FROM documents""")
def tags_mentions(t):
    return t("documents").select("doc_id", F.explode(TG.mentions("text", KINDS, 100_000, 200_000)).alias("m")).select("doc_id", "m.kind", "m.value")


@query(r"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<h[1-6][^>]*>([^<]*)', 1) AS heads, regexp_split_to_array(html, '(?i)<h[1-6][^>]*>([^<]*)') AS bodies FROM pages)
SELECT page_id, i::INT AS n, heads[i] AS heading, bodies[i + 1] AS body FROM (SELECT *, unnest(range(1, len(heads) + 1)) AS i FROM p)
UNION ALL SELECT page_id, 1, NULL, html FROM p WHERE len(heads) = 0""")
def documents_segments(t):
    return t("pages").select("page_id", F.explode(TG.segments("html", "(?i)<h[1-6][^>]*>([^<]*)")).alias("s")).select("page_id", "s.n", "s.heading", "s.body")


@query("""SELECT DISTINCT c_custkey, c_name AS question, o_orderpriority AS name, 'o/' || o_orderkey AS link FROM customer JOIN orders ON c_custkey = o_custkey""")
def documents_json_harvest(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.struct(F.col("o_orderpriority").alias("topper_name"), F.concat(F.lit("o/"), "o_orderkey").alias("url")).alias("o"))
    answers = F.struct(F.array("o").alias("answers")).alias("data")  # a small document an order, however many a customer has
    body = t("customer").join(o, "c_custkey").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("question"), answers)).alias("body"))
    return TR.harvested(body, "c_custkey", "body", ["question", "text"], ["topper_name", "name"], ["pdf_url", "url"])


CELLS = """e AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT (max(day) - CAST(dayofweek(max(day)) AS INT) - 119)::DATE AS s FROM e),
c AS (SELECT u.user_id, (s + i::INT)::DATE AS day, i // 7 AS week, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN a CROSS JOIN range(126) r(i) LEFT JOIN e ON e.user_id = u.user_id AND e.day = (s + i::INT)::DATE)"""


def _cells(t):
    counts = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    newest = t("events").agg(F.max(F.to_date("ts"))).first()[0]
    return CAL.grid(counts, "user_id", F.lit(newest))


@query(f"""WITH {CELLS}, w AS (SELECT *, (day - (dayofweek(day))::INT)::DATE AS sunday FROM c)
SELECT user_id, day, week::INT AS week, n, CASE WHEN n <= 0 THEN 0 WHEN n = 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 6 THEN 3 ELSE 4 END AS level,
CASE WHEN week = 0 OR month(sunday) <> month(sunday - 7) THEN strftime(sunday, '%b') ELSE '' END AS label FROM w""")
def calendar_grid(t):
    return _cells(t)


@query(f"WITH {CELLS} SELECT user_id, sum(n)::BIGINT AS total, count(*) FILTER (n > 0) AS active_days, sum(CASE WHEN week = 17 THEN n ELSE 0 END)::BIGINT AS this_week FROM c GROUP BY 1")
def calendar_totals(t):
    return CAL.totals(_cells(t), "user_id")


# ---- placing in a taxonomy ----

PLACE_NOISE, PLACE_STOP = ["brand", "section"], ["hot", "the"]
LABEL = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '[`''\".,()\[\]{{}}/-]+', ' ', 'g'), "
    r"'\b(?:brand|section)\b', ' ', 'g'), '\b[ivx]+\b', ' ', 'g'), '\b[0-9]+\b', ' ', 'g'), '\s+', ' ', 'g'))"
)
LABEL_TOKS = "list_filter(string_split({}, ' '), lambda x: length(x) > 2 AND x NOT IN ('hot', 'the'))"
MATCH = (
    "CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.82::DOUBLE "
    "ELSE len(list_filter({ta}, lambda x: list_contains({tb}, x)))::DOUBLE / greatest(1, least(len({ta}), len({tb}))) * 0.72::DOUBLE + len(list_filter({ta}, lambda x: list_contains({tb}, x)))::DOUBLE / greatest(1, len({ta}) + len({tb}) - len(list_filter({ta}, lambda x: list_contains({tb}, x)))) * 0.28::DOUBLE END"
)
PLACE_TAG, PLACE_Q = MATCH.format(a="tag", b="nl", ta="tag_t", tb="nl_t"), MATCH.format(a="q", b="nl", ta="q_t", tb="nl_t")


PLACED = f"""WITH nodes AS (SELECT min(p_partkey) AS ord, 'node' || min(p_partkey) AS node_id, min_by(p_type, p_partkey) AS subject, p_name AS label, min_by(p_brand, p_partkey) || ' ring' AS paper FROM part GROUP BY p_name),
n AS (SELECT *, {LABEL_TOKS.format('nl')} AS nl_t FROM (SELECT ord, node_id, subject AS ns, {LABEL.format('label')} AS nl, {LABEL.format('paper')} AS np FROM nodes)),
c AS (SELECT *, {LABEL_TOKS.format('q')} AS q_t, {LABEL_TOKS.format('tag')} AS tag_t FROM (SELECT p_partkey, p_type, p_partkey % 4 = 0 AS every, {LABEL.format("p_name || ' (' || p_brand || ')'")} AS q, string_split(p_name, ' ')[2] || ' ' || p_type AS raw, {LABEL.format("string_split(p_name, ' ')[2] || ' ' || p_type")} AS tag FROM part)),
s AS (SELECT *, round(({PLACE_TAG}) * 0.76::DOUBLE + ({PLACE_Q}) * 0.24::DOUBLE + (CASE WHEN ns = p_type THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN contains(q, np) THEN 0.04::DOUBLE ELSE 0 END), 9) AS score FROM c CROSS JOIN n),
f AS (SELECT p_partkey, max(score) AS score, arg_max(node_id, {{'s': score, 'o': -ord}}) AS node_id, arg_max(ns, {{'s': score, 'o': -ord}}) AS subject FROM s WHERE every OR ns = p_type GROUP BY 1),
g AS (SELECT p_partkey, max(score) AS score, arg_max(node_id, {{'s': score, 'o': -ord}}) AS node_id FROM s WHERE ns = p_type GROUP BY 1)
SELECT p_partkey, CASE WHEN f.score >= 0.42 THEN f.node_id WHEN g.score >= 0.18 THEN g.node_id ELSE p_type || ':topic:fallback:' || regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS node_id,
CASE WHEN f.score >= 0.42 THEN f.subject ELSE p_type END AS subject, round(CASE WHEN f.score >= 0.42 THEN f.score WHEN g.score >= 0.18 THEN g.score ELSE 0 END, 6) AS score,
CASE WHEN f.score >= 0.42 THEN 'matched' WHEN g.score >= 0.18 THEN 'within' ELSE 'made' END AS stage FROM c LEFT JOIN f USING (p_partkey) LEFT JOIN g USING (p_partkey)"""


def _placement(t, how):
    p = t("part")
    named = p.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("ord"), F.min_by("p_type", "p_partkey").alias("subject"), F.concat(F.min_by("p_brand", "p_partkey"), F.lit(" ring")).alias("paper"))
    nodes = named.withColumn("node_id", F.concat(F.lit("node"), "ord"))
    cards = p.select(
        "p_partkey", F.array(F.concat_ws(" ", F.get(F.split("p_name", " "), F.lit(1)), "p_type")).alias("tags"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("question"),
        F.when(F.col("p_partkey") % 4 != 0, F.array("p_type")).alias("subjects"), F.col("p_type").alias("hint"),
    )
    found = how(cards, nodes, "tags", "question", "subjects", "hint", "hint", PLACE_NOISE, PLACE_STOP)
    return found.select("p_partkey", "node_id", "subject", F.round("score", 6).alias("score"), "stage")


@query(PLACED)
def linking_placement(t):
    return _placement(t, PL.placed)


@query(PLACED)
def linking_placement_by_candidates(t):
    return _placement(t, PL.placed_by_candidates)
