"""Registered queries of gates and fields over lines of the documents and cards made of parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fields as FD
from .functions import gates as GT
from .functions import text as T
from .operators import people as P
from .queries import LTOKS, NAME_KEY, NOISE, NORMAL, QNORMAL, STOP, query

BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
CARD = """card AS (SELECT p_partkey, p_name, p_brand, p_type, p_size,
'Q' || (p_size % 15) || ') ' || p_name || ' in ' || (p_size * 10) || ' words (' || (p_size % 20) || ' marks) ' || (1990 + p_partkey % 50) AS q FROM part)"""
VALUES = f"""{CARD}, val AS (SELECT 'd' || doc_id || '/' || i AS id, a[i] AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
UNION ALL SELECT 'p' || p_partkey, q FROM card UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'u' || page_id, url FROM pages),
cleaned AS (SELECT id, v, trim(regexp_replace(v, '{BLANK}', ' ', 'g')) AS c FROM val)"""


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}', ' ', 'g'))"


def cards(t):
    n = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    size = F.col("p_size")
    q = F.concat(
        F.lit("Q"), n(size % 15), F.lit(") "), "p_name", F.lit(" in "), n(size * 10), F.lit(" words ("), n(size % 20), F.lit(" marks) "), n(F.lit(1990) + F.col("p_partkey") % 50)
    )
    return t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", q.alias("q"))


def values(t):
    """(id, v): lines of documents, cards, customers' names and URLs."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "v"))
    lines = lines.select(F.concat(F.lit("d"), "doc_id", F.lit("/"), (F.col("i") + 1).cast("string")).alias("id"), "v")
    one = lambda rows, mark, key, value: rows.select(F.concat(F.lit(mark), key).alias("id"), F.col(value).alias("v"))
    return lines.union(one(cards(t), "p", "p_partkey", "q")).union(one(t("customer"), "c", "c_custkey", "c_name")).union(one(t("pages"), "u", "page_id", "url"))


BARE = "regexp_replace(lower(c), '[\\s()\\[\\].,:;''\"-]+', '', 'g')"
PUBLISHABLE = f"({BARE} NOT IN ('', 'na', 'qna') AND NOT regexp_full_match({BARE}, 'q([0-9]+[a-z]?|[a-z])') AND NOT (len(regexp_extract_all(c, '[A-Za-z]')) < 8 AND starts_with(lower(c), 'q')))"
SHOWN = clean(r"regexp_replace(regexp_replace(v, '(?i)^\s*(?:Q\.?\s*)?[0-9]{1,2}\s*(?:[.)]|\([a-e]\)|[a-e][.)])?\s*', ''), '[\[\]]', '', 'g')")
SKIPPED = ", ".join(f"'{x}'" for x in GT.EMPTY_VALUES)


@query(rf"""WITH {VALUES} SELECT id, {PUBLISHABLE} AS publishable,
{PUBLISHABLE} AND length(c) >= 24 AND (len(list_filter(string_split({NORMAL.replace('text', 'c')}, ' '), lambda x: length(x) > 1)) >= 4 OR length(c) >= 40) AS useful,
length({SHOWN}) >= 12 AND NOT regexp_matches({SHOWN}, '(?i)^(?:na|qna|n/a|null|undefined)(?: na)?$') AND len(string_split({SHOWN}, ' ')) >= 3 AS displayable,
lower(trim(v)) IN ({SKIPPED}) OR starts_with(lower(trim(v)), 'not ') AS junk,
(CASE WHEN regexp_matches(c, '(?i)\bmarks?\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(c, '(?i)\banswer in [0-9]+ words?\b') THEN 0 ELSE 2 END
+ CASE WHEN len(regexp_extract_all(c, '(?i)\bq(?:uestion)?\.?\s*[0-9]+')) <= 1 THEN 2 ELSE 0 END + CASE WHEN length(c) <= 220 THEN 1 ELSE 0 END)::INT AS quality FROM cleaned""")
def gates_questions(t):
    c = F.col("c")
    return values(t).withColumn("c", GT.clean_public("v")).select(
        "id", GT.publishable("v", c).alias("publishable"), GT.useful_question("v", c).alias("useful"), GT.displayable("v").alias("displayable"), GT.junk_value("v").alias("junk"),
        GT.text_quality("v", c).alias("quality"),
    )


@query(f"SELECT doc_id, length({QNORMAL}) >= 32 AND len({LTOKS}) >= 4 AS linkable FROM documents")
def gates_linkable(t):
    return t("documents").select("doc_id", GT.linkable("text", STOP).alias("linkable"))


KINDS = ["direct", "strong", "high-confidence", "topic-match", "loose-topic-match", "reasoned", "none"]
LINK = f"""link AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {KINDS}[l_partkey % 7 + 1] AS kind, l_discount * 10 AS confidence, l_returnflag <> 'A' AS available,
l_suppkey % 5 AS page, ['valid', 'fallback', 'missing', 'out_of_range'][l_orderkey % 4 + 1] AS status, l_quantity FROM lineitem)"""


def links(t):
    pick = lambda items, k: F.element_at(F.lit(items), (F.col(k) % len(items) + 1).cast("int"))
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick(KINDS, "l_partkey").alias("kind"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") != "A").alias("available"),
        (F.col("l_suppkey") % 5).alias("page"), pick(["valid", "fallback", "missing", "out_of_range"], "l_orderkey").alias("status"), "l_quantity",
    )


@query(f"""WITH {LINK} SELECT l_orderkey, l_linenumber, kind = 'direct' OR (kind IN ('strong', 'high-confidence') AND confidence >= 0.68)
OR (kind IN ('topic-match', 'loose-topic-match', 'reasoned') AND confidence >= 0.3) AS publishable, available AND page <> 0 AND status IN ('valid', 'fallback') AS usable,
available AND 900 + floor(13 * l_quantity + 0.5) >= 1400 AS ranked,
CASE WHEN kind = 'direct' THEN 'Direct extracted question match.' WHEN kind IN ('strong', 'high-confidence') THEN 'Strong text match (' || floor(confidence * 100 + 0.5)::BIGINT || '%).'
WHEN kind = 'topic-match' THEN 'Same syllabus/topic match (' || floor(confidence * 100 + 0.5)::BIGINT || '%).' ELSE 'Loose topic match (' || floor(confidence * 100 + 0.5)::BIGINT || '%).' END AS label FROM link""")
def gates_links(t):
    return links(t).select(
        "l_orderkey", "l_linenumber", GT.publishable_link("kind", "confidence").alias("publishable"), GT.usable_source("available", "page", "status").alias("usable"),
        GT.ranked_enough(900 + F.floor(13 * F.col("l_quantity") + 0.5), "available").alias("ranked"), FD.match_label("kind", F.col("confidence")).alias("label"),
    )


QUOTED = "trim(regexp_replace(replace(replace(replace(replace(text, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '" + BLANK + "', ' ', 'g'))"


@query(f"""WITH x AS (SELECT doc_id, lang, {QUOTED} AS c, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'typed' END AS src FROM documents),
y AS (SELECT *, length(c) >= 120 AND src = 'ocr' AS scanned, {clean('text')} AS plain FROM x JOIN documents USING (doc_id))
SELECT doc_id, x.src = 'ocr' AND c <> '' AND (len(string_split(c, ' ')) >= 22 OR length(c) >= 160) AS useful,
CASE WHEN length(plain) >= 120 AND src = 'ocr' THEN plain WHEN length(y.lang || ': ' || plain) >= 120 THEN y.lang || ': ' || plain ELSE '' END AS summary,
CASE WHEN length(plain) >= 120 AND src = 'ocr' THEN 'ocr' WHEN length(y.lang || ': ' || plain) >= 120 THEN 'sheet' END AS summary_source FROM y""".replace("x.src", "src"))
def gates_summaries(t):
    d = t("documents").withColumn("src", F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("typed"))
    copy = FD.copy_summary("text", "src", F.concat("lang", F.lit(": "), "text"))
    status = F.when(F.col("src") == "ocr", "available").otherwise("missing")
    return d.select("doc_id", GT.useful_summary("text", status).alias("useful"), copy["summary"].alias("summary"), copy["source"].alias("summary_source"))


OPENINGS = ["the ", "what is", "why ", "how "]
BLOCKED = ["you are", "consider", r"q[0-9]\)", "customer"]
PROMPT = clean(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(c), '^(?:section\s+[ab]\s+|topic\s+[0-9]+\s+)?q(?:uestion)?\.?\s*[0-9]+[a-z]?\)?\s*', ''), '^[0-9]+[a-z]?[.)]\s*', ''), '^["“”'']+|["“”'']+$', '', 'g'), '[''"`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')""")
TOKENS_OF_V = LTOKS.replace("coalesce(text, '')", "coalesce(v, '')")


@query(rf"""WITH {VALUES}, n AS (SELECT *, {PROMPT} AS n FROM cleaned) SELECT id, n AS prompt,
n = '' OR len(regexp_extract_all(c, '(?i)\bq(?:uestion)?\.?\s*[0-9]+[a-z]?\b')) > 1 OR length(n) > 180 OR regexp_matches(n, '^(?:the |what is|why |how )') AS rejected,
c <> '' AND length(c) <= 180 AND len({TOKENS_OF_V}) BETWEEN 1 AND 20 AND NOT regexp_matches(c, '(?i)^(?:you are|consider|q[0-9]\)|customer)') AND length({QNORMAL.replace("coalesce(text, '')", 'c')}) >= 8 AS prompt_like FROM n""")
def gates_prompts(t):
    c, n = F.col("c"), F.col("prompt")
    rows = values(t).withColumn("c", GT.clean_public("v")).withColumn("prompt", GT.prompt_normalise("v", clean=c))
    return rows.select("id", "prompt", GT.rejected_prompt("v", OPENINGS, clean=c, normal=n).alias("rejected"), GT.prompt_like("v", T.link_tokens("v", STOP), BLOCKED, clean=c).alias("prompt_like"))


NOT_A_PERSON = [r"^customer#0*[1-9]$", r"^https?:", r"^q[0-9]+\)", "^[a-f0-9]{20,}$"]
BAD = ["the", "customer", "words", "marks"]


@query(rf"""WITH {VALUES}, k AS (SELECT *, {NAME_KEY.replace("coalesce(text, '')", 'v')} AS k FROM val), w AS (SELECT *, list_filter(string_split(k, ' '), lambda x: x <> '') AS w FROM k)
SELECT id, length(v) >= 3 AND len(regexp_extract_all(v, '[A-Za-z]')) >= 3 AND NOT regexp_matches(trim(v), '(?i)(?:^customer#0*[1-9]$|^https?:|^q[0-9]+\)|^[a-f0-9]{{20,}}$)')
AND NOT (regexp_full_match(v, '[A-Z0-9\s_-]{{3,}}') AND len(regexp_extract_all(v, '[A-Za-z]')) < 5) AS person,
len(w) BETWEEN 1 AND 4 AND (len(w) > 1 OR length(w[1]) >= 4) AND len(list_filter(w, lambda x: x IN ('the', 'customer', 'words', 'marks'))) = 0 AS plausible FROM w""")
def gates_names(t):
    return values(t).select("id", GT.person_like("v", NOT_A_PERSON).alias("person"), F.coalesce(GT.plausible_name(P.name_key("v", NOISE), BAD), F.lit(False)).alias("plausible"))


# ---- fields ----

FAR = "abs(page - guess) > 45"


@query(rf"""WITH {CARD}, x AS (SELECT *, TRY_CAST(nullif(regexp_extract(q, '(?i)\b(10|15|5)\s*marks?\b', 1), '') AS INT) AS strict, TRY_CAST(nullif(regexp_extract(q, '(?i)\(([0-9]{{1,3}})\s*marks?\)', 1), '') AS INT) AS loose,
TRY_CAST(nullif(regexp_extract(q, '\b(20[0-9]{{2}})\b', 1), '') AS INT) AS y, nullif(p_size % 15, 0) AS number, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'page' ELSE (p_partkey % 120) || '.5' END AS raw FROM card),
z AS (SELECT *, CASE WHEN raw NOT IN ('', 'page') AND p_partkey % 120 >= 1 THEN (p_partkey % 120)::INT END AS page, CASE WHEN y BETWEEN 2000 AND 2030 THEN y END AS year, (p_partkey % 90)::INT AS cnt FROM x),
g AS (SELECT *, CASE WHEN raw = '' THEN 'missing' WHEN page IS NULL THEN 'fallback' WHEN cnt BETWEEN 1 AND page - 1 THEN 'out_of_range' ELSE 'valid' END AS st, CASE WHEN number IS NOT NULL THEN 3 + (number - 1) * CASE WHEN loose = 15 THEN 3 ELSE 2 END ELSE page END AS guess FROM z),
s AS (SELECT *, CASE WHEN page IS NULL AND guess IS NOT NULL THEN 'inferred' WHEN page IS NULL THEN 'missing' WHEN number IS NOT NULL AND ((cnt = 0 AND page > greatest(80, guess + 45)) OR {FAR}) THEN 'adjusted' ELSE 'extracted' END AS src FROM g)
SELECT p_partkey, coalesce(strict, -1) AS strict_marks, coalesce(loose, -1) AS any_marks, coalesce(year, -1) AS year, coalesce(number, -1)::INT AS number, coalesce(page, -1) AS page, st AS status,
(CASE WHEN src IN ('inferred', 'adjusted') THEN guess ELSE coalesce(page, -1) END)::INT AS answer_page, CASE WHEN src IN ('inferred', 'adjusted') THEN 'fallback' ELSE st END AS answer_status, src AS answer_source FROM s""")
def fields_marks_and_pages(t):
    c, p = cards(t), F.col("p_partkey")
    raw = F.when(p % 7 == 0, "").when(p % 7 == 1, "page").otherwise(F.concat((p % 120).cast("string"), F.lit(".5")))
    c = c.withColumn("raw", raw).withColumn("cnt", (p % 90).cast("int"))
    none = lambda x: F.coalesce(x, F.lit(-1))
    page, status = FD.page_number("raw"), FD.page_status("raw", "cnt")
    answer = FD.answer_page(page, status, "q", FD.marks("q"), F.col("cnt"))
    return c.select(
        "p_partkey", none(FD.marks("q", [10, 15, 5])).alias("strict_marks"), none(FD.marks("q")).alias("any_marks"), none(FD.year_of("q")).alias("year"), none(FD.question_number("q")).alias("number"),
        none(page).alias("page"), status.alias("status"), none(answer["page"]).alias("answer_page"), answer["status"].alias("answer_status"), answer["source"].alias("answer_source"),
    )


@query(r"""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (c_custkey * 7) || '' WHEN 1 THEN 'AIR ' || c_custkey || ' Copy' WHEN 2 THEN 'Rank: ' || c_custkey ELSE c_name END AS v, c_custkey % 3 AS k, c_nationkey FROM customer),
r AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(v, '^([0-9]{1,9})(?:\.[0-9]*)?$', 1), ''), nullif(regexp_extract(v, '(?i)\b(?:air|rank)\s*[-:]?\s*([0-9]{1,4})\b', 1), '')) AS INT) AS n,
'copy ' || (1995 + c_custkey % 40) || ' final' AS file FROM x),
y AS (SELECT *, CASE WHEN k = 0 THEN 2000 + c_nationkey END AS own, CASE WHEN k = 1 THEN 2010 + c_nationkey END AS other, TRY_CAST(nullif(regexp_extract(file, '\b(20[0-9]{2})\b', 1), '') AS INT) AS named FROM r)
SELECT c_custkey, CASE WHEN n BETWEEN 1 AND 2000 THEN n ELSE -1 END AS rank, coalesce(CASE WHEN own BETWEEN 2000 AND 2030 THEN own END, CASE WHEN other BETWEEN 2000 AND 2030 THEN other END, CASE WHEN named BETWEEN 2000 AND 2029 THEN named END, -1)::INT AS year,
CASE WHEN own BETWEEN 2000 AND 2030 THEN 'extracted' WHEN other BETWEEN 2000 AND 2030 THEN 'question' WHEN named BETWEEN 2000 AND 2029 THEN 'filename' END AS year_source,
coalesce(CASE WHEN n BETWEEN 1 AND 2000 THEN n END, c_nationkey)::INT AS known, CASE WHEN n BETWEEN 1 AND 2000 THEN 'record' ELSE 'entity' END AS known_source FROM y""")
def fields_ranks_and_years(t):
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, (k * 7).cast("string")).when(k % 4 == 1, F.concat(F.lit("AIR "), k, F.lit(" Copy"))).when(k % 4 == 2, F.concat(F.lit("Rank: "), k)).otherwise(F.col("c_name"))
    c = t("customer").withColumn("v", v).withColumn("file", F.concat(F.lit("copy "), (F.lit(1995) + k % 40).cast("string"), F.lit(" final")))
    year = FD.inferred_year(F.when(k % 3 == 0, F.lit(2000) + F.col("c_nationkey")), F.when(k % 3 == 1, F.lit(2010) + F.col("c_nationkey")), "file")
    known = FD.first_known(("record", FD.rank_of("v")), ("entity", F.col("c_nationkey").cast("int")))
    return c.select("c_custkey", F.coalesce(FD.rank_of("v"), F.lit(-1)).alias("rank"), F.coalesce(year["value"], F.lit(-1)).alias("year"), year["source"].alias("year_source"), known["value"].alias("known"), known["source"].alias("known_source"))


@query(rf"""WITH x AS (SELECT page_id, url, lower(url) AS u, '{{"a":' || page_id || '}}' AS j FROM pages)
SELECT page_id, regexp_replace(regexp_replace(u, '[?#].*$', ''), '^https?://(www\.|m\.)?', '') AS canonical, starts_with(url, 'https://') AND NOT regexp_matches(url, '[?#@]') AS allowed,
nullif(regexp_extract('https://x.org/file/d/' || page_id || '/view', '/file/d/([^/?#]+)', 1), '') AS drive, CASE WHEN contains(url, 'www.') THEN 'web' WHEN contains(url, '//m.') THEN 'mobile' ELSE 'other' END AS class,
CASE WHEN page_id % 3 = 0 THEN '10.0.0.' || page_id WHEN page_id % 3 = 1 THEN 'real' || page_id ELSE 'local' END AS client,
CASE WHEN page_id % 2 = 0 THEN j END AS fenced, replace(replace('a"b\' || url, '\', '\\'), '"', '\"') AS escaped FROM x""")
def fields_links(t):
    k = F.col("page_id")
    j = F.concat(F.lit('{"a":'), k, F.lit("}"))
    p = t("pages").withColumn("raw", F.when(k % 2 == 0, F.concat(F.lit("said ```json\n"), j, F.lit("\n``` end"))).otherwise(F.lit("nothing")))
    p = p.withColumn("forwarded", F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), k, F.lit(", 1.1.1.1")))).withColumn("real", F.when(k % 3 == 1, F.concat(F.lit("real"), k)))
    return p.select(
        "page_id", FD.canonical_url("url").alias("canonical"), FD.allowed_url("url").alias("allowed"), FD.drive_id(F.concat(F.lit("https://x.org/file/d/"), k, F.lit("/view"))).alias("drive"),
        FD.link_class("url", {"web": ["www."], "mobile": ["//m."]}, "other").alias("class"), FD.client_key("forwarded", "real").alias("client"), FD.fenced_json("raw").alias("fenced"),
        FD.json_escaped(F.concat(F.lit('a"b\\'), "url")).alias("escaped"),
    )


STUDY = clean(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(v, '+/-', 'plus/minus'), '(?i)[\w ()-]*\.pdf\b', '', 'g'), '\bdrive_[A-Za-z0-9_-]+', '', 'g'), '(?i)\b(?:customer)\b', '', 'g'), '\b[0-9]{{9,}}\b', '', 'g')")


@query(rf"""WITH {VALUES}, f AS (SELECT id || ' copy.PDF drive_' || id || ' 1234567890 ' || v AS v, id, v AS w FROM val),
c AS (SELECT p_partkey, q, p_name || '|page ' || p_size || '| ' || p_brand || ' |NA' AS tags FROM card)
SELECT id, {STUDY} AS study, -1::BIGINT AS n FROM f
UNION ALL SELECT 'q' || p_partkey, regexp_replace(q, '\)$', '') || ' / ' || array_to_string(list_filter(list_transform(string_split(tags, '|'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^page [0-9]+$') AND lower(x) <> 'na'), ';'), 2 FROM c""")
def fields_study_texts(t):
    f = values(t).select("id", FD.study_text(F.concat("id", F.lit(" copy.PDF drive_"), "id", F.lit(" 1234567890 "), "v"), ["customer"]).alias("study"), F.lit(-1).cast("long").alias("n"))
    tags = FD.tag_candidates(F.array(F.concat("p_name", F.lit("|page "), F.col("p_size").cast("string")), F.concat(F.lit(" "), "p_brand", F.lit(" |NA"))))
    c = cards(t).withColumn("tags", tags)
    return f.union(c.select(F.concat(F.lit("q"), "p_partkey"), F.concat(FD.with_marks("q", F.col("p_size")), F.lit(" / "), F.array_join("tags", ";")), F.size("tags").cast("long")))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x0b\\x{a0}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, substr(array_to_string(list_filter(l, lambda x: NOT contains(lower(x), 'license') AND NOT contains(lower(x), 'password') AND NOT starts_with(lower(x), 'the')), ' '), 1, 520) AS kept FROM l""")
def fields_kept_lines(t):
    return t("documents").select("doc_id", FD.kept_lines("text", ["license", "password"], ["the"]).alias("kept"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, text, list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(trim(x)) > 30 AND NOT starts_with(trim(x), '---') AND NOT starts_with(trim(x), '#')) AS b FROM documents),
s(doc_id, i, made, done) AS (SELECT doc_id, 0, '', len(b) = 0 FROM b UNION ALL
SELECT s.doc_id, i + 1, CASE WHEN length(made) + length(b[i + 1]) > 1200 THEN CASE WHEN 1200 - length(made) > 50 THEN made || substr(b[i + 1], 1, 1200 - length(made)) || '…' ELSE made END
ELSE made || CASE WHEN made = '' THEN '' ELSE chr(10) || chr(10) END || b[i + 1] END, length(made) + length(b[i + 1]) > 1200 OR i + 1 = len(b) FROM s JOIN b USING (doc_id) WHERE NOT done)
SELECT doc_id, CASE WHEN made <> '' THEN made ELSE substr(text, 1, 1200) || '…' END AS summary FROM s JOIN b USING (doc_id) WHERE done""")
def fields_paragraph_summary(t):
    return t("documents").select("doc_id", FD.paragraph_summary("text").alias("summary"))


@query("""WITH x AS (SELECT conv_id, list({'p': turn, 'w': len(regexp_extract_all(text, '[A-Za-z0-9_]+'))} ORDER BY turn) AS p, (conv_id % 9)::BIGINT AS hint FROM conversations GROUP BY conv_id),
c AS (SELECT *, list_transform(p, lambda y: y.p) AS n FROM x)
SELECT conv_id, CASE WHEN len(p) <= 3 THEN array_to_string(n, ',') ELSE array_to_string(list_sort(list_distinct(list_filter([n[1], list_sort(list_transform(p, lambda y: {'w': y.w, 'n': -y.p}))[-1].n * -1,
CASE WHEN hint BETWEEN 1 AND n[-1] THEN hint END, n[-1]], lambda y: y IS NOT NULL)))[:4], ',') END AS pages, round(least(0.55 + least(list_sum(list_transform(p, lambda y: y.w)) / 5000, 0.25), 0.8), 6) AS confidence FROM c""")
def fields_chosen_pages(t):
    pages = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("page"), T.word_count("text").alias("words"))))
    c = t("conversations").groupBy("conv_id").agg(pages.alias("p")).withColumn("hint", F.col("conv_id") % 9)
    words = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return c.select("conv_id", F.array_join(FD.chosen_pages(F.col("p"), F.col("hint")).cast("array<string>"), ",").alias("pages"), F.round(FD.extraction_confidence(words), 6).alias("confidence"))


HINT = r"(?i)\b(?:Q\.?\s*)?([0-9]{1,2}\s*\(?[a-e]?\)?\.?)\s+([0-9]{1,3}(?:\.[0-9]+)?)\s+(?:/\s*)?([0-9]{1,3})\b"


@query(rf"""WITH x AS (SELECT o_custkey, string_agg('Q' || (o_orderkey % 9 + 1) || ' ' || (o_orderkey % 13) || ' / ' || (o_orderkey % 11), chr(10) ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey),
h AS (SELECT o_custkey, list_zip(list_transform(regexp_extract_all(v, '{HINT}', 2), lambda y: y::DOUBLE), list_transform(regexp_extract_all(v, '{HINT}', 3), lambda y: y::DOUBLE)) AS z FROM x),
o AS (SELECT o_custkey, list_filter(z, lambda y: y[1] <= y[2] AND y[2] <= 250) AS z FROM h)
SELECT o_custkey, len(z)::INT AS n, list_sum(list_transform(z, lambda y: y[1])) AS total FROM o""")
def fields_score_hints(t):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("Q"), (k % 9 + 1).cast("string"), F.lit(" "), (k % 13).cast("string"), F.lit(" / "), (k % 11).cast("string"))
    sheets = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("v"))
    hints = FD.score_hints("v")
    return sheets.select("o_custkey", hints["n"].alias("n"), hints["total"].alias("total"))


@query(r"""WITH x AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'pyq:' || event_id WHEN 1 THEN 'ans_' || substr(sha256(event_id || ''), 1, 16) WHEN 2 THEN 'rel_' || event_id WHEN 3 THEN 'other:' || event_id ELSE event_type END AS i,
CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' User ' || user_id END AS s, CASE WHEN event_id % 4 > 0 THEN ts - INTERVAL 1 DAY * (event_id % 4 - 2) END AS o FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'pyq' WHEN event_id % 5 = 1 THEN 'topper_copy' WHEN event_id % 5 = 2 THEN 'relevant_question' ELSE 'pyq' END AS kind,
coalesce(nullif(lower(trim(s)), ''), 'anon') AS scope, coalesce(greatest(ts, o), ts) AS latest, regexp_replace(regexp_replace(lower(trim(s)), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS subject FROM x""")
def fields_items(t):
    k = F.col("event_id")
    i = (
        F.when(k % 5 == 0, F.concat(F.lit("pyq:"), k)).when(k % 5 == 1, F.concat(F.lit("ans_"), F.substring(F.sha2(k.cast("string"), 256), 1, 16)))
        .when(k % 5 == 2, F.concat(F.lit("rel_"), k)).when(k % 5 == 3, F.concat(F.lit("other:"), k)).otherwise(F.col("event_type"))
    )
    e = t("events").withColumn("i", i).withColumn("s", F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" User "), "user_id")))
    e = e.withColumn("o", F.when(k % 4 > 0, F.col("ts") - F.make_dt_interval((k % 4 - 2).cast("int"))))
    patterns = [("topper_copy", "(?i)^ans_[a-f0-9]{16}$"), ("relevant_question", "(?i)_ans_[a-f0-9]{16}$|^rel_")]
    kind = FD.item_type("i", ["pyq", "topper_copy", "relevant_question"], patterns, "pyq")
    return e.select("event_id", kind.alias("kind"), FD.scope("s").alias("scope"), FD.later_of("ts", "o").alias("latest"), FD.subject_key("s").alias("subject"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Source ' || lpad(c_custkey || '', 3, '0') ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Copy' END AS title,
trim(c_name || ' ' || c_mktsegment) AS search FROM customer""")
def fields_file_titles(t):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.lit("drive_AbCdEf12.md")).otherwise(F.concat("c_mktsegment", F.lit("-copy_COMPLETE.md")))
    return t("customer").select("c_custkey", FD.file_title(name, k).alias("title"), FD.search_text("c_name", F.lit(None).cast("string"), "c_mktsegment").alias("search"))


@query(r"""WITH x AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'plain' ELSE 'json' END AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 'json' THEN 'say "' || o_orderpriority || '"' || chr(10) || 'fig ' || o_orderstatus END AS texts, array_to_string(list_filter(['diagram:' || o_orderpriority, CASE WHEN o_orderkey % 4 > 0 THEN 'quote:' || o_orderstatus END], lambda v: v IS NOT NULL), ';') AS adds,
CASE WHEN o_orderkey % 2 = 0 THEN repeat('word ' , 12) || o_orderkey ELSE 'Answer to: q ' || o_orderkey || CASE WHEN o_orderkey % 4 > 0 THEN ' With diagram, quote.' ELSE ' With diagram.' END END AS summary,
CASE WHEN o_orderkey % 2 = 0 THEN 'available' ELSE 'too_thin' END AS status, regexp_matches(o_orderpriority, '(?i)^(?:1|2)\b') AS instruction, o_orderkey % 5 > 0 AS complete FROM x""")
def fields_json_and_templates(t):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit('say "'), "o_orderpriority", F.lit('"')).alias("text"), F.struct(F.concat(F.lit("fig "), "o_orderstatus").alias("alt")).alias("img"))).alias("parts")))
    o = t("orders").withColumn("body", F.when(k % 3 == 0, "plain").otherwise(body))
    o = o.withColumn("adds", FD.value_adds([("diagram", F.col("o_orderpriority")), ("quote", F.when(k % 4 > 0, F.col("o_orderstatus")).otherwise("not given"))]))
    kinds = F.transform("adds", lambda x: x["type"])
    told = FD.summary_or_template(F.when(k % 2 == 0, F.concat(F.repeat(F.lit("word "), 12), k)).otherwise("thin"), F.concat(F.lit("q "), k), kinds)
    return o.select(
        "o_orderkey", FD.json_texts("body").alias("texts"), F.array_join(F.transform("adds", lambda x: F.concat(x["type"], F.lit(":"), x["value"])), ";").alias("adds"), told["text"].alias("summary"),
        told["status"].alias("status"), GT.instruction_segment("o_orderpriority", ["1", "2"]).alias("instruction"), GT.complete("o_orderstatus", F.when(k % 5 > 0, "x")).alias("complete"),
    )


# ---- picks and lists ----


@query("""SELECT doc_id, ['first', 'second', 'third'][(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 + 1)::INT] AS pick FROM documents""")
def fields_hash_picks(t):
    return t("documents").select("doc_id", T.hash_pick(["first", "second", "third"], F.col("doc_id").cast("string")).alias("pick"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS items FROM documents""")
def fields_comma_lists(t):
    return t("documents").select("doc_id", F.array_join(T.listed("text"), "|").alias("items"))
