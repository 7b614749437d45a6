"""Registered queries of sources over grids, lines, JSON bodies and file lists made of the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .queries import NORMAL, query
from .sources import files as FI
from .sources import imports as IM


def text(c):
    return F.col(c).cast("string")


@query("""WITH r AS (SELECT p_brand, p_name, p_type, p_size, 1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT p_brand AS sheet_name, i::INT AS row_index, array_to_string(list_filter(['name=' || p_name, CASE WHEN p_size % 5 > 0 THEN 'size_mm=' || p_size END, CASE WHEN p_size % 3 > 0 THEN 'type=' || p_type END], lambda x: x IS NOT NULL), ';') AS record FROM r""")
def sources_grid(t):
    p = t("part")
    sheets = p.select(F.col("p_brand").alias("sheet_name")).distinct()
    fixed = sheets.select("sheet_name", F.explode(F.array(F.struct(F.lit(0).alias("row_index"), F.array(F.lit("Disclaimer: name and type as sold"), F.lit("")).alias("cells")), F.struct(F.lit(1).alias("row_index"), F.array(F.lit(" Name "), F.lit("Type"), F.lit("Size (mm)")).alias("cells")))).alias("x"))
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1
    cells = F.array("p_name", F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise(" "), F.when(F.col("p_size") % 5 > 0, text("p_size")))
    grid = fixed.select("sheet_name", "x.row_index", "x.cells").union(p.select(F.col("p_brand"), i, cells)).withColumn("source_file", F.lit("parts"))
    found = FI.records(grid, FI.header_rows(grid, ["name", "type", "size"], ["disclaimer"]))
    return found.select("sheet_name", "row_index", F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("record"))


IMPORT = """g AS (SELECT p_name AS k, CASE WHEN min(p_partkey) % 3 = 0 THEN 'Other' ELSE min_by(p_type, p_partkey) END AS category FROM part WHERE p_size < 20 GROUP BY 1), e AS (SELECT DISTINCT p_name AS k, p_brand AS entry FROM part WHERE p_size < 20),
r AS (SELECT p_name AS k, CASE WHEN p_partkey % 4 = 0 THEN 'Other' ELSE p_type END AS category, p_brand AS entry, p_partkey AS ord FROM part WHERE p_size >= 20),
c AS (SELECT k, min_by(category, ord) FILTER (category <> 'Other') AS n FROM r GROUP BY 1),
m AS (SELECT coalesce(g.k, c.k) AS k, CASE WHEN (g.category = 'Other' AND n IS NOT NULL) OR g.category IS NULL THEN coalesce(n, 'Other') ELSE g.category END AS category, g.k IS NULL AS created, coalesce(g.category = 'Other' AND n IS NOT NULL, false) AS filled FROM g FULL JOIN c ON g.k = c.k),
a AS (SELECT k, entry, min(ord) AS ord FROM r WHERE (k, entry) NOT IN (SELECT (k, entry) FROM e) GROUP BY 1, 2)"""


def _import(t):
    p = t("part")
    old, new = p.filter("p_size < 20"), p.filter("p_size >= 20")
    groups = old.groupBy(F.col("p_name").alias("k")).agg(F.when(F.min("p_partkey") % 3 == 0, "Other").otherwise(F.min_by("p_type", "p_partkey")).alias("category"))
    entries = old.select(F.col("p_name").alias("k"), F.col("p_brand").alias("entry")).distinct()
    rows = new.select(F.col("p_name").alias("k"), F.when(F.col("p_partkey") % 4 == 0, "Other").otherwise(F.col("p_type")).alias("category"), F.col("p_brand").alias("entry"), F.col("p_partkey").alias("ord"))
    return IM.merged_import(groups, entries, rows, "k", "category", "entry", "ord")


@query(f"WITH {IMPORT} SELECT k, category, created, filled, coalesce(n, 0) AS added FROM m LEFT JOIN (SELECT k, count(*) AS n FROM a GROUP BY 1) USING (k)")
def sources_import(t):
    groups, new, _ = _import(t)
    return groups.join(new.groupBy("k").agg(F.count("*").alias("n")), "k", "left").select("k", "category", "created", "filled", F.coalesce("n", F.lit(0)).alias("added"))


@query(f"WITH {IMPORT} SELECT (SELECT count(*) FROM r) AS read, (SELECT count(*) FROM a) AS added, count(*) FILTER (created) AS created, count(*) FILTER (filled) AS filled, (SELECT count(*) FROM r) - (SELECT count(*) FROM a) AS skipped FROM m")
def sources_import_counts(t):
    return _import(t)[2]


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, o_orderstatus AS paper, (o_orderkey % 25)::INT AS number, o_orderpriority AS area, 'order ' || o_custkey AS question, CASE WHEN o_orderkey % 25 <= 10 THEN 10 ELSE 15 END AS marks FROM orders WHERE o_orderkey % 5 > 0""")
def sources_prose_rows(t):
    o = t("orders")
    row = F.concat_ws("\t", F.year("o_orderdate").cast("string"), "o_orderstatus", (F.col("o_orderkey") % 25).cast("string"), "o_orderpriority", F.concat(F.lit("order "), "o_custkey", F.lit(" #"), "o_orderkey"))
    rows = FI.prose_rows(o.select(F.when(F.col("o_orderkey") % 5 > 0, row).otherwise(F.concat(F.lit("Orders of "), row)).alias("value")))
    key = F.regexp_extract("question", "#([0-9]+)$", 1).cast("long")
    return rows.select(key.alias("o_orderkey"), "year", "paper", "number", "area", F.regexp_replace("question", " #[0-9]+$", "").alias("question"), "marks")


LINES = """l AS (SELECT user_id AS doc, event_id AS n, CASE event_type WHEN 'signup' THEN '## S' || event_id WHEN 'error' THEN '**' || (2000 + event_id % 30) || '**' ELSE '* ' || event_type || ' ' || event_id END AS value FROM events)"""


def _lines(t):
    k = F.col("event_id")
    v = F.when(F.col("event_type") == "signup", F.concat(F.lit("## S"), k)).when(F.col("event_type") == "error", F.concat(F.lit("**"), (2000 + k % 30).cast("string"), F.lit("**")))
    return t("events").select(F.col("user_id").alias("doc"), k.alias("n"), v.otherwise(F.concat(F.lit("* "), "event_type", F.lit(" "), k)).alias("value"))


@query(f"""WITH {LINES}, c AS (SELECT *, last_value(CASE WHEN value LIKE '## %' THEN substr(value, 4) END IGNORE NULLS) OVER w AS section, last_value(TRY_CAST(nullif(regexp_extract(value, '^\\*\\*([0-9]{{4}})\\*\\*', 1), '') AS INT) IGNORE NULLS) OVER w AS year FROM l WINDOW w AS (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc, n, coalesce(section, '') AS section, coalesce(year, -1) AS year, trim(substr(value, 3)) AS prompt FROM c WHERE value LIKE '* %'""")
def sources_bullets(t):
    return FI.sectioned_bullets(_lines(t)).withColumn("section", F.coalesce("section", F.lit(""))).withColumn("year", F.coalesce("year", F.lit(-1)))


SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), ''), 'q')"


@query(f"""WITH l AS (SELECT user_id AS doc, event_id AS n, CASE event_type WHEN 'signup' THEN 'IV. Group ' || event_id % 7 WHEN 'error' THEN 'page ' || event_id ELSE '- Topic ' || event_id % 11 END AS v FROM events),
c AS (SELECT *, nullif(regexp_extract(v, '^(?:[IVX]+|[0-9]+)\\.\\s+(.+)$', 1), '') AS head FROM l WHERE NOT starts_with(v, 'page')), g AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM c),
x AS (SELECT doc, n, head, CASE WHEN head IS NULL AND grp IS NOT NULL THEN {SLUG.format('grp')} END AS parent, coalesce(head, regexp_replace(v, '^[-*]\\s*', '')) AS label FROM g), y AS (SELECT *, concat_ws(':', parent, {SLUG.format('label')}) AS id FROM x)
SELECT doc, id, coalesce(parent, '') AS parent, label, n AS ord, CASE WHEN head IS NULL THEN 'topic' ELSE 'group' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY n) AS r FROM y) WHERE r = 1""")
def sources_outline(t):
    k = F.col("event_id")
    v = F.when(F.col("event_type") == "signup", F.concat(F.lit("IV. Group "), (k % 7).cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("page "), k)).otherwise(F.concat(F.lit("- Topic "), (k % 11).cast("string")))
    nodes = IM.outline(t("events").select(F.col("user_id").alias("doc"), k.alias("n"), v.alias("value")), "doc", "n", "value", "^page")
    return nodes.withColumn("parent", F.coalesce("parent", F.lit("")))


@query("""SELECT id, question, min(ord) AS ord FROM (SELECT 'q' || o_custkey AS id, 'status ' || o_orderstatus AS question, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 3 < 2) WHERE r = 1 GROUP BY 1, 2""")
def sources_captures(t):
    o = t("orders")
    one = F.struct(F.concat(F.lit("q"), "o_custkey").alias("id"), F.concat(F.lit("status "), "o_orderstatus").alias("question"))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.array(one).alias("pyqs")))).when(F.col("o_orderkey") % 3 == 1, F.to_json(one)).otherwise("<p>")
    return FI.captured_questions(o.select(F.col("o_orderkey").alias("ord"), body.alias("text")))


@query("""WITH f AS (SELECT n_regionkey, min(n_nationkey) AS first FROM nation GROUP BY 1) SELECT 'r' || n_regionkey AS subject, n_nationkey || '' AS topic_id, n_name AS name, 0::INT AS ord FROM nation JOIN f USING (n_regionkey) WHERE n_nationkey = first""")
def sources_captured_topics(t):
    topics = F.array(F.struct(text("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    body = F.to_json(F.struct(F.concat(F.lit("r"), text("n_regionkey")).alias("subject"), topics.alias("topics")))
    entries = t("nation").select(F.col("n_nationkey").alias("ord"), F.lit("https://x.org/api/syllabus").alias("url"), body.alias("body"))
    return IM.captured_topics(entries, "url", "body", "/syllabus", "ord")


@query("""SELECT DISTINCT 'of ' || o_custkey AS question, o_orderpriority AS name, 'o/' || o_orderstatus AS url FROM orders""")
def sources_shapes(t):
    q, name, url = F.concat(F.lit("of "), "o_custkey"), F.col("o_orderpriority"), F.concat(F.lit("o/"), "o_orderstatus")
    a, b = F.struct(name.alias("topper_name"), url.alias("pdf_url")), F.struct(name.alias("name"), url.alias("url"))
    flat = F.to_json(F.struct(q.alias("text"), F.array(b).alias("answers")))
    apart = F.to_json(F.struct(F.array(F.struct(F.lit("1").alias("id"), q.alias("question"))).alias("questions"), F.array(F.struct(F.lit("1").alias("question_id"), name.alias("name"), url.alias("pdf_url"))).alias("topper_answers")))
    nested = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(q.alias("question"), F.array(a).alias("topper_answers"))).alias("pyqs"))).alias("syllabus")))
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, flat).when(k == 1, apart).when(k == 2, nested).otherwise(F.concat(F.lit('{"data":'), apart, F.lit("}")))
    return IM.answer_triples(t("orders").select(F.col("o_orderkey").alias("ord"), body.alias("body")), "body", "ord")


@query("""WITH f AS (SELECT c_custkey, 'scan ' || c_nationkey || '.pdf' AS name, 'u/' || c_custkey AS url FROM customer), k AS (SELECT name AS key, url, c_custkey FROM f UNION SELECT regexp_replace(name, '\\.[a-z0-9]{2,4}$', ''), url, c_custkey FROM f)
SELECT key, min_by(url, c_custkey) AS url FROM k GROUP BY 1""")
def sources_url_map(t):
    f = t("customer").select("c_custkey", F.concat(F.lit("Scan "), text("c_nationkey"), F.lit(".PDF")).alias("name"), F.concat(F.lit("u/"), "c_custkey").alias("url"))
    return IM.url_map(f, "name", "url", "c_custkey")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 3 AS k FROM customer), w AS (SELECT 'N' || c_nationkey AS drive_id, CASE WHEN min(k) FILTER (k < 2) = 0 THEN 'complete' ELSE 'master' END AS kind FROM c WHERE k < 2 GROUP BY 1)
SELECT drive_id, kind, -1 AS page FROM w UNION ALL SELECT 'N' || c_nationkey, 'page', (c_custkey % 90)::INT FROM c WHERE k = 2""")
def sources_scans(t):
    k = F.col("c_custkey")
    end = F.when(k % 3 == 0, "_COMPLETE.md").when(k % 3 == 1, "_MASTER.md").otherwise(F.concat(F.lit("_p"), (k % 90).cast("string"), F.lit("_COMPLETE.md")))
    files = t("customer").select(F.concat(F.lit("a/b/drive_N"), text("c_nationkey"), end).alias("path"))
    return IM.scanned_documents(files, "path").select("drive_id", "kind", F.coalesce("page", F.lit(-1)).alias("page"))


@query("""WITH f AS (SELECT 'd' || c_nationkey || '/drive_C' || c_custkey || '.pdf' AS path, 'C' || c_custkey AS i FROM customer), k AS (SELECT lower('drive_' || i || '.pdf') AS key, path FROM f UNION ALL SELECT lower(i || '.pdf'), path FROM f UNION ALL SELECT lower(i), path FROM f UNION ALL SELECT lower('https://h/file/d/' || i), path FROM f)
SELECT key, min(path) AS path FROM k GROUP BY 1""")
def sources_catalogue(t):
    files = t("customer").select(F.concat(F.lit("d"), text("c_nationkey"), F.lit("/drive_C"), text("c_custkey"), F.lit(".pdf")).alias("path"))
    return IM.catalogued(files, "path", "https://h")


@query("""SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN count(*) WHEN o_custkey % 3 = 1 THEN max(o_orderkey % 50 + 1) ELSE -1 END::INT AS pages FROM orders GROUP BY 1""")
def sources_page_counts(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = F.when(c % 3 == 0, "<< /Type /Page >> /Type /Pages ").when(c % 3 == 1, F.concat(F.lit("/Count "), (k % 50 + 1).cast("string"), F.lit(" "))).otherwise("%PDF ")
    docs = t("orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(part), "").alias("content"))
    return docs.select("o_custkey", F.coalesce(IM.page_count("content"), F.lit(-1)).alias("pages"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'f/drive_C' || c_custkey || '.pdf' END AS path, CASE WHEN c_custkey % 3 < 2 THEN (c_custkey % 40)::INT END AS pages FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, NULL, -1 FROM customer WHERE c_custkey % 3 = 2""")
def sources_document_facts(t):
    k = F.col("c_custkey")
    files = t("customer").filter("c_custkey % 3 < 2").select(F.concat(F.lit("f/drive_C"), k, F.lit(".pdf")).alias("file"), (k % 40).cast("int").alias("count"))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://h/x/drive_C"), k, F.lit(".pdf?x=1"))).when(k % 3 == 1, F.concat(F.lit("https://g/file/d/C"), k, F.lit("/view"))).otherwise("https://g/none.pdf")
    return IM.document_facts(t("customer").select("c_custkey", url.alias("url")), files, "url", "file", "count").select("c_custkey", "path", F.coalesce("pages", F.lit(-1)).alias("pages"))


@query("""WITH r AS (SELECT p_name AS name, p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 3 = 0 THEN 'u/' || p_partkey END AS c2, CASE WHEN p_partkey % 5 > 0 THEN 'v/' || p_partkey END AS c1 FROM part), k AS (SELECT 'f/' || name AS key, coalesce(c2, c1) AS url, i FROM r WHERE coalesce(c2, c1) IS NOT NULL UNION ALL SELECT name, coalesce(c2, c1), i FROM r WHERE coalesce(c2, c1) IS NOT NULL)
SELECT key, max_by(url, i) AS url FROM k GROUP BY 1""")
def sources_link_sheet(t):
    k = F.col("p_partkey")
    cells = F.array(F.concat(F.lit("f/"), "p_name"), F.when(k % 5 > 0, F.concat(F.lit("v/"), k)), F.when(k % 3 == 0, F.concat(F.lit("u/"), k)).otherwise(" "))
    return IM.link_sheet(t("part").select(F.lit("links").alias("sheet_name"), (k + 1).alias("row_index"), cells.alias("cells")), "links")


RUN = "r AS (SELECT l_partkey, 'run-' || l_suppkey % 9 AS run, l_shipdate AS at, l_orderkey * 100000 + l_linenumber * 1000 + l_quantity::BIGINT AS result FROM lineitem)"


@query(f"""WITH {RUN} SELECT l_partkey, run, "at", result FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY "at", run, result) AS r FROM r) WHERE r = 1""")
def sources_runs(t):
    rows = t("lineitem").select("l_partkey", F.concat(F.lit("run-"), (F.col("l_suppkey") % 9).cast("string"), ).alias("run"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")).alias("result"))
    one = rows.groupBy("l_partkey", "run", "at").agg(F.min("result").alias("result"))
    return IM.run_results(one, "l_partkey", "run", "at")[0].select("l_partkey", "run", "at", "result")


@query(f"""WITH {RUN} SELECT count(*) AS processed, count(DISTINCT l_partkey) AS keys, max_by(run, ("at", run)) AS latest FROM r""")
def sources_run_sums(t):
    rows = t("lineitem").select("l_partkey", F.concat(F.lit("run-"), (F.col("l_suppkey") % 9).cast("string")).alias("run"), F.col("l_shipdate").alias("at"))
    return IM.run_results(rows, "l_partkey", "run", "at")[1]


@query("""WITH a AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, first FROM a UNION ALL SELECT user_id, first FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def sources_appended(t):
    e = t("events").select("user_id", F.col("event_id").alias("first"))
    kept = e.filter("first % 2 = 0").groupBy("user_id").agg(F.min("first").alias("first"))
    return IM.appended(kept, e.filter("first % 2 = 1"), "user_id", ["first"])


@query("""WITH q AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'p/' || page_id // 8 WHEN page_id % 4 = 1 THEN url WHEN page_id % 4 = 2 THEN 'i' || page_id // 3 ELSE 'row-' || page_id END AS key FROM pages)
SELECT page_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS r FROM q) WHERE r = 1 AND key NOT IN (SELECT 'row-' || page_id FROM pages WHERE page_id % 3 = 0)""")
def sources_queue(t):
    k = F.col("page_id")
    half = lambda n: F.floor(k / n).cast("string")
    rows = t("pages").select(
        "page_id", F.when(k % 4 == 0, F.concat(F.lit("p/"), half(8))).alias("path"), F.when(k % 4 == 1, F.col("url")).otherwise(" ").alias("link"), F.when(k % 4 == 2, F.concat(F.lit("i"), half(3))).alias("ident")
    )
    done = t("pages").filter("page_id % 3 = 0").select(F.concat(F.lit("row-"), "page_id").alias("key"))
    return IM.work_queue(rows, done, "page_id").select("page_id", "key")


@query(f"""WITH k AS (SELECT doc_id, unnest(list_filter(string_split({NORMAL}, ' '), lambda x: x <> '')) AS token FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)),
s AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS slot, sum(CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM k GROUP BY 1, 2)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE v <> 0""")
def sources_hashed_features(t):
    known = t("embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    d = t("documents").join(known, "doc_id", "left_anti").select("doc_id", T.tokens(T.search_normalise("text")).alias("toks"))
    return IM.hashed_features(d, "doc_id", "toks").withColumn("value", F.round("value", 6))


@query("""SELECT 'orders' AS run, TIMESTAMP '2024-01-01' AS "at", count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderkey) AS last FROM orders""")
def sources_manifest(t):
    m = IM.manifest(t("orders"), "orders", "2024-01-01", {"done": F.count_if(F.col("o_orderstatus") == "F"), "last": F.max("o_orderkey")})
    return m.withColumn("at", F.col("at").cast("timestamp_ntz"))
