"""Fields from texts, links and file names: marks, ranks, years, pages, scores, summaries, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .gates import BEGIN, END, clean_public


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first(t: Column, *patterns: str) -> Column:
    """First group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])


def study_text(c: Column | str, phrases: list[str] = ()) -> Column:
    """Without PDF file names, drive ids, ``phrases`` (patterns) and numbers of nine digits."""
    t = F.regexp_replace(T.text(c), r"\+/-", "plus/minus")
    for p in (rf"(?i)[\w ()-]*\.pdf{END}", rf"{BEGIN}drive_[A-Za-z0-9_-]+", *(rf"(?i){BEGIN}(?:{p}){END}" for p in phrases), rf"{BEGIN}[0-9]{{9,}}{END}"):
        t = F.regexp_replace(t, p, "")
    return clean_public(t)


def paragraph_summary(c: Column | str, size: int = 1200, least: int = 30, tail: int = 50) -> Column:
    """Whole paragraphs of more than ``least`` characters while they fit in ``size``, then the part of the next that fits if that is over ``tail``."""
    t = T.text(c)
    good = F.filter(F.split(t, "\n\n"), lambda b: (F.length(F.trim(b)) > least) & ~F.trim(b).startswith("---") & ~F.trim(b).startswith("#"))
    none = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(a: Column, b: Column) -> Column:
        left = F.lit(size) - F.length(a["s"])
        over = F.length(a["s"]) + F.length(b) > size
        part = F.when(left > tail, F.concat(a["s"], F.substring(b, F.lit(1), left), F.lit("…"))).otherwise(a["s"])
        whole = F.concat(a["s"], F.when(a["s"] == "", "").otherwise("\n\n"), b)
        return F.when(a["full"], a).otherwise(F.struct(F.when(over, part).otherwise(whole).alias("s"), over.alias("full")))

    made = F.aggregate(good, none, add, lambda a: a["s"])
    return F.when(made != "", made).otherwise(F.concat(F.substring(t, 1, size), F.lit("…")))


def kept_lines(c: Column | str, within: list[str], openings: list[str], size: int = 520) -> Column:
    """Lines that hold none of ``within`` and begin with none of ``openings`` (lower case), joined and cut."""
    lines = F.filter(F.transform(F.split(T.text(c), r"\r?\n"), clean_public), lambda x: x != "")
    bad = lambda x: F.exists(F.lit(within), lambda w: F.lower(x).contains(w)) | F.exists(F.lit(openings), lambda w: F.lower(x).startswith(w))
    return F.substring(F.array_join(F.filter(lines, lambda x: ~bad(x)), " "), 1, size)


def marks(c: Column | str, allowed: list[int] | None = None) -> Column:
    """``15 marks`` or ``(15 m`` with one of the ``allowed`` numbers; any of one to three digits if None."""
    n = "[0-9]{1,3}" if allowed is None else "|".join(map(str, allowed))
    short = [rf"(?i)\(({n})\s*m"] if allowed else []
    bracketed = [rf"(?i)\(([0-9]{{1,3}})\s*marks?\)"] if allowed is None else []
    return _first(T.text(c), *bracketed, rf"(?i){BEGIN}({n})\s*marks?{END}", *short).cast("int")


def rank_of(c: Column | str, most: int = 2000) -> Column:
    """A plain number, or one after ``air`` or ``rank``; 1 to ``most``."""
    t = F.trim(T.text(c))
    n = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9]{1,9})(?:\.[0-9]*)?$", 1), F.lit("")), _first(t, rf"(?i){BEGIN}(?:air|rank)\s*[-:]?\s*([0-9]{{1,4}}){END}")).cast("int")
    return F.when(n.between(1, most), n)


def year_of(c: Column | str, low: int = 2000, high: int = 2030) -> Column:
    """First 20xx that stands alone, if within low and high."""
    y = _first(T.text(c), rf"{BEGIN}(20[0-9]{{2}}){END}").cast("int")
    return F.when(y.between(low, high), y)


def inferred_year(own: Column | str, other: Column | str, file_name: Column | str) -> Column:
    """struct(value, source): the own year, the question's, or one in the file name."""
    ok = lambda c: F.when(_col(c).between(2000, 2030), _col(c).cast("int"))
    named = year_of(file_name, 2000, 2029)
    value = F.coalesce(ok(own), ok(other), named)
    source = F.when(ok(own).isNotNull(), "extracted").when(ok(other).isNotNull(), "question").when(named.isNotNull(), "filename")
    return F.struct(value.alias("value"), source.alias("source"))


def page_number(c: Column | str) -> Column:
    """A number of 1 or more, its fraction cut; else null."""
    n = F.trim(T.text(c)).try_cast("double")
    return F.when(n >= 1, F.floor(n).cast("int"))


def page_status(raw: Column | str, count: Column | str) -> Column:
    """missing, fallback (not a number), out_of_range, or valid."""
    page, n = page_number(raw), _col(count)
    return F.when(F.trim(T.text(raw)) == "", "missing").when(page.isNull(), "fallback").when(F.coalesce(n, F.lit(0)).between(1, page - 1), "out_of_range").otherwise("valid")


def question_number(c: Column | str) -> Column:
    n = _first(T.text(c), rf"(?i){BEGIN}Q(?:uestion)?\.?\s*([0-9]{{1,2}})", r"^\s*([0-9]{1,2})\s*[.)]").cast("int")
    return F.when(n > 0, n)


def answer_page(page: Column, status: Column, question: Column | str, of_marks: Column, count: Column, far: int = 45) -> Column:
    """struct(page, status, source): the page as given, or what the question's number implies: 3 + (number - 1) * 2 pages, 3 for 15 marks.

    A page ``far`` from that, or beyond 80 without a page count, is replaced.
    """
    n = question_number(question)
    guess = F.when(n.isNotNull(), 3 + (n - 1) * F.when(of_marks == 15, 3).otherwise(2)).otherwise(page)
    lost = page.isNotNull() & n.isNotNull() & ((F.coalesce(count, F.lit(0)) == 0) & (page > F.greatest(F.lit(80), guess + far)) | (F.abs(page - guess) > far))
    source = F.when(page.isNull() & guess.isNotNull(), "inferred").when(page.isNull(), "missing").when(lost, "adjusted").otherwise("extracted")
    made = source.isin("inferred", "adjusted")
    return F.struct(F.when(made, guess).otherwise(page).alias("page"), F.when(made, "fallback").otherwise(status).alias("status"), source.alias("source"))


def drive_id(url: Column | str) -> Column:
    return _first(T.text(url), r"/file/d/([^/?#]+)", r"(?i)/drive_([^/?#]+?)\.pdf(?:[?#]|$)")


def link_class(url: Column | str, hosts: dict[str, list[str]], default: str) -> Column:
    """none for no link, the class whose text it holds, else ``default``."""
    u = T.text(url)
    out = F.when(u == "", "none")
    for name, parts in hosts.items():
        out = out.when(F.exists(F.lit(parts), lambda p: u.contains(p)), name)
    return out.otherwise(default)


def canonical_url(url: Column | str) -> Column:
    """Lower case without scheme, ``www.`` or ``m.``, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.text(url)), r"[?#].*$", ""), r"^https?://(www\.|m\.)?", "")


def host(url: Column | str) -> Column:
    return F.regexp_extract(F.lower(T.text(url)), r"^https?://([^/?#]+)", 1)


def allowed_url(url: Column | str, hosts: list[str] | None = None) -> Column:
    """https, no credentials, query or fragment, and one of ``hosts`` if given."""
    u = T.text(url)
    ok = u.startswith("https://") & ~u.rlike("[?#@]")
    return ok & host(u).isin(hosts) if hosts else ok


def score_hints(c: Column | str) -> Column:
    """struct(n, total): ``3(a) 7.5/10`` scores that are not above their maximum, 250 at most."""
    p = rf"(?i){BEGIN}(?:Q\.?\s*)?([0-9]{{1,2}}\s*\(?[a-e]?\)?\.?)\s+([0-9]{{1,3}}(?:\.[0-9]+)?)\s+(?:/\s*)?([0-9]{{1,3}}){END}"
    got, top = (F.transform(F.regexp_extract_all(T.text(c), F.lit(p), F.lit(g)), lambda x: x.cast("double")) for g in (2, 3))
    ok = F.filter(F.arrays_zip(got.alias("a"), top.alias("b")), lambda x: (x["a"] <= x["b"]) & (x["b"] <= 250))
    total = F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, x: s + x["a"]))
    return F.struct(F.size(ok).alias("n"), total.alias("total"))


def with_marks(question: Column | str, n: Column) -> Column:
    """The question, with its marks if it doesn't say them."""
    q = T.text(question)
    silent = (F.coalesce(n, F.lit(0)) != 0) & ~q.rlike(rf"(?i){BEGIN}marks?{END}")
    return F.when(silent, F.concat(q, F.lit(" ("), n.cast("string"), F.lit(" marks)"))).otherwise(q)


def match_label(kind: Column | str, confidence: Column) -> Column:
    k, pct = T.text(kind), F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%)."))
    return (
        F.when(k.isin("direct", "exact"), "Direct extracted question match.")
        .when(k.isin("strong", "high-confidence"), F.concat(F.lit("Strong text match ("), pct))
        .when(k == "topic-match", F.concat(F.lit("Same syllabus/topic match ("), pct))
        .otherwise(F.concat(F.lit("Loose topic match ("), pct))
    )


def search_text(*parts: Column | str) -> Column:
    """Non-empty parts, cleaned and joined."""
    clean = F.transform(F.array(*[T.text(_col(p).cast("string")) for p in parts]), T.clean_blank)
    return F.array_join(F.filter(clean, lambda x: x != ""), " ")


def chosen_pages(pages: Column, hint: Column, most: int = 4) -> Column:
    """Of struct(page, words): all if there are three at most, else the first, the richest, the hinted and the last, in order."""
    numbers = F.transform(pages, lambda p: p["page"])
    rich = F.array_max(F.transform(pages, lambda p: F.struct(p["words"].alias("w"), (-p["page"]).alias("n"))))
    last = F.array_max(numbers)
    four = F.array(F.array_min(numbers), -rich["n"], F.when(hint.between(1, last), hint), last)
    return F.when(F.size(pages) <= 3, F.array_sort(F.array_distinct(numbers))).otherwise(F.slice(F.array_sort(F.array_distinct(F.array_compact(four))), 1, most))


def extraction_confidence(words: Column) -> Column:
    return F.least(0.55 + F.least(words / 5000, F.lit(0.25)), F.lit(0.8))


def tag_candidates(values: Column, most: int = 18) -> Column:
    """Parts between bars, cleaned; page marks and ``na`` out; the first ``most``."""
    parts = F.transform(F.flatten(F.transform(values, lambda v: F.split(T.text(v), r"\|"))), clean_public)
    return F.slice(F.filter(parts, lambda v: (v != "") & ~v.rlike(r"(?i)^page [0-9]+$") & (F.lower(v) != "na")), 1, most)


def fenced_json(c: Column | str) -> Column:
    """From the first brace to the last, inside a ```json fence if there is one; null without braces."""
    t = T.text(c)
    inner = F.regexp_extract(t, r"(?is)```json\s*(.*?)```", 1)
    raw = F.when(inner != "", inner).otherwise(t)
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def json_escaped(c: Column | str) -> Column:
    """Backslashes, quotes and control characters escaped as in a JSON string."""
    t = T.text(c)
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(char), F.lit(code))
    return t


def item_type(ident: Column | str, kinds: list[str], patterns: list[tuple[str, str]], default: str) -> Column:
    """The kind before a colon if it is one of ``kinds`` and something follows, else by pattern."""
    i = T.text(ident)
    kind = F.substring_index(i, ":", 1)
    return F.when(i.contains(":") & kind.isin(kinds) & (F.length(i) > F.length(kind) + 1), kind).otherwise(T.classify(i, patterns, default))


def later_of(a: Column | str, b: Column | str) -> Column:
    """The later of two timestamps; the other where one is null."""
    return F.greatest(_col(a), _col(b))


def scope(c: Column | str, default: str = "anon") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(T.text(c))), F.lit("")), F.lit(default))


def subject_key(c: Column | str) -> Column:
    """Lower case without white space and punctuation but dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(T.text(c))), r"\s+", "-"), "[^a-z0-9-]", "")


def file_title(c: Column | str, number: Column, default: str = "Source", size: int = 72) -> Column:
    """A title from a file name: ending, prefix and marks out; numbered default where only an id is left."""
    t = F.regexp_replace(T.text(c), r"(?i)\.[a-z0-9]{2,4}$", "")
    t = F.regexp_replace(F.regexp_replace(t, "^drive_[A-Za-z0-9]+_?", ""), r"(?i)_?(?:COMPLETE|MASTER)$", "")
    t = clean_public(F.regexp_replace(t, "[-_]", " "))
    bad = (t == "") | t.rlike("^[A-Za-z0-9]{16,}$")
    return F.when(bad, F.concat(F.lit(f"{default} "), F.lpad(number.cast("string"), 3, "0"))).otherwise(F.substring(T.title_case(t), 1, size))


def copy_summary(ocr: Column | str, source: Column | str, sheet: Column | str, least: int = 120) -> Column:
    """struct(summary, source): the text read from the scan if long enough and its source says so, else the sheet's, else nothing."""
    a, b = clean_public(ocr), clean_public(sheet)
    scanned, typed = (F.length(a) >= least) & (T.text(source) == "ocr"), F.length(b) >= least
    return F.struct(F.when(scanned, a).when(typed, b).otherwise("").alias("summary"), F.when(scanned, "ocr").when(typed, "sheet").alias("source"))


def client_key(forwarded: Column | str, real: Column | str, default: str = "local") -> Column:
    """First forwarded address, else the real one, else ``default``."""
    first = F.trim(F.get(F.split(T.text(forwarded), ","), 0))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(T.text(real)), F.lit("")), F.lit(default))


def first_known(*sources: tuple[str, Column]) -> Column:
    """struct(value, source): the first value that is not null, and the name of its source."""
    value = F.coalesce(*[c for _, c in sources])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources])
    return F.struct(value.alias("value"), source.alias("source"))


def json_texts(c: Column | str, names: list[str] = ("text", "alt")) -> Column:
    """Of a text that is JSON: the string values under ``names`` at any depth, in their order, joined by new lines; null if it is no JSON or has none."""
    t = F.trim(T.text(c))
    found = F.regexp_extract_all(t, F.lit(rf'"(?:{"|".join(names)})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(found, lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    kept = F.filter(plain, lambda v: F.trim(v) != "")
    return F.when((t.startswith("{") | t.startswith("[")) & (F.size(kept) > 0), F.array_join(kept, "\n"))


def value_adds(fields: list[tuple[str, Column]]) -> Column:
    """(type, value) of the named fields that say something."""
    from .gates import junk_value

    each = F.array(*[F.struct(F.lit(name).alias("type"), F.trim(T.text(c)).alias("value")) for name, c in fields])
    return F.filter(each, lambda x: ~junk_value(x["value"]))


def summary_or_template(summary: Column | str, question: Column | str, kinds: Column, least: int = 60) -> Column:
    """struct(text, status): the summary if it has ``least`` characters, else a sentence made of the question and the kinds of value added."""
    s, q = clean_public(summary), clean_public(question)
    made = F.concat(F.lit("Answer to: "), T.clip(q, 120), F.when(F.size(kinds) > 0, F.concat(F.lit(" With "), F.array_join(kinds, ", "), F.lit("."))).otherwise(""))
    return F.struct(F.when(F.length(s) >= least, s).otherwise(made).alias("text"), F.when(F.length(s) >= least, "available").when(s != "", "too_thin").otherwise("missing").alias("status"))
