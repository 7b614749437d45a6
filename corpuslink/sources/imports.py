"""Imports into existing groups, outlines, captures of several shapes, catalogues of files, runs and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as FD
from ..functions import text as T
from ..operators.grouping import first_per_key


def merged_import(groups: DataFrame, entries: DataFrame, rows: DataFrame, key: str, category: str, entry: str, order: str, other: str = "Other") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imported ``rows`` in existing groups and entries: groups (key, category, created, filled), new entries, and one row of counters.

    A key without a group makes one; a category of ``other`` takes the first imported one that is another; an entry that its group has is skipped.
    """
    named = F.when(F.col(category) != other, F.col(order))
    come = rows.groupBy(key).agg(F.min_by(category, named).alias("_new"))
    both = groups.select(key, F.col(category).alias("_old")).join(come, key, "full")
    fill = (F.col("_old") == other) & F.col("_new").isNotNull()
    merged = both.select(
        key, F.when(fill | F.col("_old").isNull(), F.coalesce("_new", F.lit(other))).otherwise(F.col("_old")).alias(category), F.col("_old").isNull().alias("created"),
        F.coalesce(fill, F.lit(False)).alias("filled"),
    )
    new = first_per_key(rows, [key, entry], [order]).select(key, entry, order).join(entries.select(key, entry), [key, entry], "left_anti")
    sums = rows.agg(F.count("*").alias("read")).join(new.agg(F.count("*").alias("added"))).join(merged.agg(F.count_if("created").alias("created"), F.count_if("filled").alias("filled")))
    return merged, new, sums.withColumn("skipped", F.col("read") - F.col("added"))


def outline(lines: DataFrame, document: str, order: str, value: str, noise: str) -> DataFrame:
    """Nodes of a two-level outline: ``I. Group`` headings, and the lines below them; lines that match ``noise`` are left out.

    (document, id, parent, label, ord, kind); of nodes with one id the first stays.
    """
    v = F.trim(F.col(value))
    head = F.nullif(F.regexp_extract(v, r"^(?:[IVX]+|[0-9]+)\.\s+(.+)$", 1), F.lit(""))
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter((v != "") & ~v.rlike(noise)).select(document, order, head.alias("head"), v.alias("v"))
    rows = rows.withColumn("group", F.last("head", True).over(w))
    label = F.coalesce("head", F.regexp_replace("v", r"^[-*]\s*", ""))
    up = F.when(F.col("head").isNull() & F.col("group").isNotNull(), T.slug("group"))
    rows = rows.select(
        document, F.concat_ws(":", up, T.slug(label)).alias("id"), up.alias("parent"), label.alias("label"), F.col(order).alias("ord"), F.when(F.col("head").isNull(), "topic").otherwise("group").alias("kind")
    )
    return first_per_key(rows, [document, "id"], ["ord"])


TOPIC = "id string, name string"
ANSWER = "topper_name string, name string, url string, pdf_url string"
SHAPES = f"""
question string, text string, answers array<struct<{ANSWER.replace(' string', ': string')}>>,
questions array<struct<id: string, question: string>>, topper_answers array<struct<question_id: string, {ANSWER.replace(' string', ': string')}>>,
syllabus array<struct<pyqs: array<struct<question: string, topper_answers: array<struct<{ANSWER.replace(' string', ': string')}>>>>>>
"""


def captured_topics(entries: DataFrame, url: str, body: str, marker: str, order: str) -> DataFrame:
    """(subject, topic_id, name, ord): topics of the first captured response of each subject whose URL holds ``marker``."""
    shape = f"subject string, topics array<struct<{TOPIC.replace(' string', ': string')}>>"
    rows = entries.filter(F.col(url).contains(marker)).select(order, F.from_json(body, shape).alias("b")).select(order, "b.*").filter("subject is not null")
    first = first_per_key(rows, ["subject"], [order])
    return first.select("subject", F.posexplode("topics").alias("ord", "t")).select("subject", F.col("t.id").alias("topic_id"), "t.name", "ord")


def answer_triples(bodies: DataFrame, body: str, order: str) -> DataFrame:
    """Distinct (question, name, url) of JSON bodies of several shapes: one question with answers, separate arrays to join, nested topics, each bare or
    wrapped in ``data``. Names and links have synonyms; rows without a question or a name are left out.
    """
    parsed = bodies.select(F.col(order).alias("_o"), F.from_json(F.coalesce(F.get_json_object(body, "$.data"), F.col(body)), SHAPES).alias("b"))
    answer = lambda a: F.struct(F.coalesce(a["topper_name"], a["name"]).alias("name"), F.coalesce(a["pdf_url"], a["url"]).alias("url"))
    flat = parsed.select(F.coalesce("b.question", "b.text").alias("question"), F.explode("b.answers").alias("a"))
    nested = parsed.select(F.explode("b.syllabus").alias("s")).select(F.explode("s.pyqs").alias("q")).select("q.question", F.explode("q.topper_answers").alias("a"))
    asked = parsed.select("_o", F.explode("b.questions").alias("q")).select("_o", F.col("q.id").alias("question_id"), "q.question")
    given = parsed.select("_o", F.explode("b.topper_answers").alias("a")).withColumn("question_id", F.col("a.question_id"))
    joined = asked.join(given, ["_o", "question_id"]).select("question", "a")
    rows = [df.select("question", answer(F.col("a")).alias("x")).select("question", "x.name", "x.url") for df in (flat, nested, joined)]
    every = rows[0].union(rows[1]).union(rows[2])
    return every.filter((T.text("question") != "") & (T.text("name") != "")).distinct()


def url_map(triples: DataFrame, name: str, url: str, order: str) -> DataFrame:
    """(key, url): file names and persons' names as keys, file names also without their ending; the first of each key stays."""
    base = F.lower(F.trim(T.text(name)))
    keys = F.array_distinct(F.array(base, F.regexp_replace(base, r"\.[a-z0-9]{2,4}$", "")))
    each = triples.filter((base != "") & (T.text(url) != "")).select(F.explode(keys).alias("key"), F.col(url).alias("url"), F.col(order).alias("ord"))
    return first_per_key(each, ["key"], ["ord", "url"]).select("key", "url")


def scanned_documents(files: DataFrame, path: str) -> DataFrame:
    """(drive_id, kind, page, path): what the names of scanned files say; of an id's whole documents a complete one goes before a master."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    ident = F.regexp_extract(name, r"^drive_(.+?)(?:_p[0-9]+)?_(?:COMPLETE|MASTER)\.md$", 1)
    page = F.nullif(F.regexp_extract(name, r"_p([0-9]+)_COMPLETE\.md$", 1), F.lit("")).cast("int")
    kind = F.when(page.isNotNull(), "page").when(name.endswith("_COMPLETE.md"), "complete").when(name.endswith("_MASTER.md"), "master")
    rows = files.select(ident.alias("drive_id"), kind.alias("kind"), page.alias("page"), F.col(path).alias("path")).filter("kind is not null and drive_id != ''")
    whole = first_per_key(rows.filter("kind != 'page'"), ["drive_id"], [F.when(F.col("kind") == "complete", 0).otherwise(1), "path"])
    return whole.unionByName(rows.filter("kind = 'page'"))


def catalogued(files: DataFrame, path: str, host: str) -> DataFrame:
    """(key, path): each file under its name, the name without its prefix, its id, and its share link; the least path of each key."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    ident = F.regexp_replace(F.regexp_replace(name, "^drive_", ""), r"\.[A-Za-z0-9]{2,4}$", "")
    keys = F.array_distinct(F.array(name, F.regexp_replace(name, "^drive_", ""), ident, F.concat(F.lit(f"{host}/file/d/"), ident)))
    each = files.select(F.explode(F.transform(keys, lambda k: F.lower(k))).alias("key"), F.col(path).alias("path"))
    return each.filter("key != ''").groupBy("key").agg(F.min("path").alias("path"))


def page_count(content: Column | str) -> Column:
    """Pages of a binary document given as Latin-1 text: page objects, else the greatest count it states, else null."""
    t = T.text(content)
    pages = F.regexp_count(t, F.lit(r"/Type\s*/Page(?![A-Za-z0-9_])"))
    stated = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"/Count\s+([0-9]{1,9})"), F.lit(1)), lambda x: x.cast("int")))
    return F.when(pages > 0, pages).when(stated > 0, stated)


def document_facts(links: DataFrame, files: DataFrame, url: str, path: str, pages: str) -> DataFrame:
    """``links`` with the path and pages of their document: by the link's base name, else by the spellings of its id."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(T.text(url), "[?#].*$", ""), "/"), -1))
    ident = F.lower(FD.drive_id(url))
    spelt = files.select(F.lower(F.element_at(F.split(F.col(path), "/"), -1)).alias("_n"), F.col(path).alias("_p"), F.col(pages).alias("_c"))
    spelt = spelt.groupBy("_n").agg(F.min_by(F.struct("_p", "_c"), "_p").alias("_f"))
    rows, names = links, []
    for i, key in enumerate((name, F.concat(F.lit("drive_"), ident, F.lit(".pdf")), F.concat(ident, F.lit(".pdf")))):
        rows = rows.withColumn("_n", key).join(spelt.withColumnRenamed("_f", f"_f{i}"), "_n", "left").drop("_n")
        names.append(f"_f{i}")
    found = F.coalesce(*names)
    return rows.withColumn("path", found["_p"]).withColumn("pages", found["_c"]).drop(*names)


def link_sheet(grid: DataFrame, sheet: str) -> DataFrame:
    """(key, url): a sheet's first column as file name, with and without its path's folder, to the third column, else the second; the header is skipped, the last row wins."""
    cell = lambda i: F.nullif(F.trim(T.text(F.get("cells", F.lit(i)))), F.lit(""))
    rows = grid.filter((F.col("sheet_name") == sheet) & (F.col("row_index") > 0)).select("row_index", cell(0).alias("name"), F.coalesce(cell(2), cell(1)).alias("url"))
    rows = rows.filter("name is not null and url is not null")
    each = rows.select(F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", "/"), -1)))).alias("key"), "url", "row_index")
    return each.groupBy("key").agg(F.max_by("url", "row_index").alias("url"))


def run_results(results: DataFrame, key: str, run: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The first result of each key by (time, run), and one row of sums: results, keys, latest run. A new run appends rows; earlier keys keep theirs."""
    first = first_per_key(results, [key], [at, run])
    sums = results.agg(F.count("*").alias("processed"), F.count_distinct(key).alias("keys"), F.max_by(run, F.struct(at, run)).alias("latest"))
    return first, sums


def appended(kept: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``kept`` and the first new row of each key that it lacks."""
    return kept.unionByName(first_per_key(new, [key], order).join(kept.select(key), key, "left_anti"))


def work_queue(entries: DataFrame, done: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """One row a document that is not done: its key is the path, else the link, else the id, else made from the order; the first entry of each stays."""
    key = F.coalesce(*[F.nullif(F.trim(T.text(c)), F.lit("")) for c in ("path", "link", "ident")], F.concat(F.lit("row-"), F.col(order).cast("string")))
    rows = first_per_key(entries.withColumn("key", key), ["key"], [order]).join(done.select("key"), "key", "left_anti")
    return rows.orderBy(order).limit(limit) if limit else rows


def manifest(rows: DataFrame, name: str, at: str, counters: dict[str, Column]) -> DataFrame:
    """One row about a run: its name and time, how many rows, and the named counters."""
    sums = rows.agg(F.count("*").alias("n_rows"), *[c.alias(k) for k, c in counters.items()])
    return sums.select(F.lit(name).alias("run"), F.lit(at).cast("timestamp").alias("at"), "*")


def refreshed(tables: dict[str, DataFrame], path: str, version: str) -> list[str]:
    """All ``tables`` under a new version, and then the pointer to it: readers see the old set or the new one, never a mixture."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return sorted(tables)


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


# ---- vectors by feature hashing ----


def hashed_features(rows: DataFrame, ident: str, toks: str, width: int = 256) -> DataFrame:
    """(id, slot, value): signed token counts in ``width`` slots by the tokens' digests, scaled to length 1; rows whose slots cancel out have none."""
    digest = F.md5(F.col("token").cast("binary"))
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    each = rows.select(ident, F.explode(toks).alias("token")).select(ident, (number(1, 8) % width).alias("slot"), F.when(number(9, 1) % 2 == 0, 1.0).otherwise(-1.0).alias("v"))
    sums = each.groupBy(ident, "slot").agg(F.sum("v").alias("v")).filter("v != 0")
    norm = sums.groupBy(ident).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, ident).select(ident, "slot", (F.col("v") / F.col("norm")).alias("value"))


def backfilled(rows: DataFrame, ident: str, toks: str, vector: str, width: int = 256) -> DataFrame:
    """``rows`` with vectors made for those that have none, by feature hashing; others keep theirs."""
    made = hashed_features(rows.filter(F.col(vector).isNull()), ident, toks, width)
    slots = made.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_m"))  # at most `width` entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0.0)).cast("float"))
    return rows.join(slots, ident, "left").withColumn(vector, F.when(F.col("_m").isNotNull(), dense).otherwise(F.col(vector))).drop("_m")
