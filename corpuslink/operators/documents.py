"""Documents from pages: segments between markers, prompts, and one job from pages to documents, chunks, concepts and their index.

Segments are rows: the offsets of markers come from the lengths of what a pattern matches and of what stands between, summed along one
text. Concepts come from a dictionary table by ``phrases.phrase_hits``, so its size doesn't matter to the texts.

Defined results: null texts are empty; a text without a marker is one segment without a marker; what stands before the first marker is segment 0,
if it isn't blank; repeated ids are texts of their own in ``marked_segments``; offsets count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .merging import concept_index
from .phrases import first_named, phrase_hits, run_hits
from .rounds import settled


def marked_segments(rows: DataFrame, ident: str, text: str, marker: str) -> DataFrame:
    """(ident, n, at, marker, body): what each marker is followed by up to the next one; at: where the marker begins. ``marker``: a pattern."""
    t = rows.select(ident, F.monotonically_increasing_id().alias("_row"), T.text(text).alias("_t"))
    cut = t.select(ident, "_row", F.regexp_extract_all("_t", F.lit(marker), F.lit(0)).alias("m"), F.split("_t", marker, -1).alias("g"))
    each = cut.select(ident, "_row", "m", F.posexplode("g").alias("n", "body")).withColumn("marker", F.get("m", F.col("n") - 1)).drop("m")
    size = F.length("body") + F.coalesce(F.length("marker"), F.lit(0))
    before = F.sum(size).over(Window.partitionBy("_row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))  # one text's segments
    found = each.withColumn("at", F.coalesce(before, F.lit(0)).cast("int")).withColumn("_k", F.max("n").over(Window.partitionBy("_row")))
    return found.filter((F.col("n") > 0) | (F.trim("body") != "") | (F.col("_k") == 0)).select(ident, "_row", "n", "at", "marker", "body")


def cleaned_prompt(c: Column) -> Column:
    """One line without the section's name or the number in front."""
    t = F.regexp_replace(F.translate(c, "\u00a0", " "), r"(?i)^section\s*[-:]\s*[a-z]\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[0-9]{1,2}\s+", ""), r"\s+", " "))


def prompts(rows: DataFrame, ident: str, text: str, marker: str, instruction: str) -> DataFrame:
    """(ident, place, prompt): the texts after markers, cleaned, in order, each once whatever its case; none that begins like an ``instruction`` (a pattern).

    A text of which nothing is left so is its own prompt, cleaned. ``ident`` must be unique.
    """
    cut = marked_segments(rows.select(ident, cleaned_prompt(T.text(text)).alias("_c")), ident, "_c", marker)
    said = cut.filter("n > 0").select(ident, "n", cleaned_prompt(F.regexp_replace("body", r"^[\s.):-]+", "")).alias("prompt"))
    said = said.filter((F.col("prompt") != "") & ~F.col("prompt").rlike(instruction))
    whole = rows.select(ident, F.lit(0).alias("n"), cleaned_prompt(T.text(text)).alias("prompt")).filter("prompt != ''")
    every = said.unionByName(whole.join(said.select(ident).distinct(), ident, "left_anti"))
    first = every.groupBy(ident, F.lower("prompt").alias("_l")).agg(F.min(F.struct("n", "prompt")).alias("x"))
    place = F.row_number().over(Window.partitionBy(ident).orderBy("x.n"))
    return first.select(ident, place.alias("place"), "x.prompt")


def vault(
    pages: DataFrame, dictionary: DataFrame, doc: str, page: str, text: str, subject: str, concept: str, want: str, words: list[str],
    least: int = 8, of_document: int = 40, of_chunk: int = 16, sizes: list[int] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and the concept index of ``pages`` (doc, page, text, subject).

    ``dictionary``: (ord, ``want``: tokens, ``concept``). Documents: pages, pages of more than ``least`` words, words, question lines, subject (the least), and
    the ``of_document`` longest concepts; chunks: such pages with their words, question lines and ``of_chunk`` longest concepts. A
    concept that begins on one page and ends on the next is not found. ``sizes``: the numbers of tokens that concepts have, if they are few and known;
    ``want`` is then a text, tokens with single spaces, and may be ``concept`` itself.

    A document's first concepts are among the first of its chunks, so no more than these are stored.
    """
    each = pages.select(
        T.stable_id("chunk_", 12, doc, page).alias("chunk_id"), doc, page, subject, T.word_count(text).alias("words"),
        F.size(T.question_lines(text, 28, 320, words)).alias("questions"), T.tokens(T.search_normalise(text)).alias("_toks"),
    )
    if sizes is None:
        hits = phrase_hits(each.select("chunk_id", "_toks"), dictionary.select("ord", want), "chunk_id", "_toks", want).join(dictionary.select("ord", concept), "ord")
    else:
        hits = run_hits(each.select("chunk_id", "_toks"), dictionary.select(*dict.fromkeys(["ord", want, concept])), "chunk_id", "_toks", want, sizes)
    order = [F.desc(F.length(concept)), concept]
    none = F.array().cast("array<string>")
    tagged = settled(first_named(hits.select("chunk_id", concept), "chunk_id", concept, order, max(of_chunk, of_document)))
    listed = tagged.select("chunk_id", F.slice("tags", 1, of_chunk).alias("concepts"))
    chunks = each.filter(F.col("words") > least).drop("_toks").join(listed, "chunk_id", "left").withColumn("concepts", F.coalesce("concepts", none))
    in_doc = tagged.join(each.select("chunk_id", doc), "chunk_id").select(doc, F.explode("tags").alias(concept)).distinct()
    named = first_named(in_doc, doc, concept, order, of_document).select(doc, F.col("tags").alias("concepts"))
    sums = each.groupBy(doc).agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("words") > least, 1)).alias("text_pages"), F.sum("words").alias("words"), F.sum("questions").alias("questions"), F.min(subject).alias(subject)
    )
    documents = sums.join(named, doc, "left").withColumn("concepts", F.coalesce("concepts", none))
    return documents, chunks, concept_index(documents, chunks, doc, subject, "concepts")
