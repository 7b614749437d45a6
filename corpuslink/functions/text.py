"""Text functions: Column to Column, no user functions.

White space is given as an explicit class, so that no-break spaces count, and word boundaries as ASCII look-arounds, so
that accented letters don't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s   -     　﻿]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once: a column's expression within a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def search_normalise(c: Column | str) -> Column:
    """Lower case; runs of anything but ASCII letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    """Tokens of a normalised text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def terms(normal: Column) -> Column:
    """Tokens of at least two characters."""
    return F.filter(F.split(normal, " "), lambda t: F.length(t) > 1)


def question_normalise(c: Column | str) -> Column:
    """Notes of marks go, in brackets with all that these hold; then the number in front; ``&`` is and; then as for search.

    A number in front is a q with or without a dot, digits, a part letter and a mark, each of which may be missing, or up to two digits with a mark. Texts
    that can't hold either aren't searched for it.
    """
    t = F.lower(text(c))
    note = r"(?<![a-z0-9_])[0-9]{1,3}\s*marks?"
    within = "|".join(rf"\{a}[^\{b}]*{note}[^\{b}]*\{b}" for a, b in ("()", "[]"))
    bare = rf"{note}(?:\s*/\s*[0-9]+\s*words?)?(?![a-z0-9_])"
    t = F.when(t.contains("mark"), F.regexp_replace(F.regexp_replace(t, within, ""), bare, "")).otherwise(t)
    mark = r"[.)\]:-]"
    front = F.regexp_replace(F.regexp_replace(t, rf"^\s*q\.?\s*[0-9]{{0,2}}\s*[a-e]?\s*{mark}?\s*", ""), rf"^\s*qa?\s*{mark}?\s*", "")
    t = F.when(t.rlike(r"^\s*[q0-9]"), F.regexp_replace(front, rf"^\s*[0-9]{{1,2}}\s*{mark}\s*", "")).otherwise(t)
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def stem(t: Column) -> Column:
    """Light stemmer: -isation(s), analys, two centuries, then ies, ing, ed, s where enough of the word remains."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(t.endswith("isation"), F.concat(cut(7), F.lit("ization")))
        .when(t.endswith("isations"), F.concat(cut(8), F.lit("ization")))
        .when(t.endswith("analys"), F.concat(t, F.lit("i")))  # analysis, and then its last s
        .when(t == "nineteenth", "19th").when(t == "twentieth", "20th")
        .when(t.endswith("ies") & (n > 6), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ing") & (n > 7), cut(3))
        .when(t.endswith("ed") & (n > 6), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss") & (n > 5), cut(1))
        .otherwise(t)
    )


def link_tokens(c: Column | str, stop: list[str]) -> Column:
    """Stemmed tokens for linking: three characters or more, or two to four digits; stop words out; repeats stay."""
    stemmed = F.transform(tokens(question_normalise(c)), stem)
    return F.filter(stemmed, lambda t: ((F.length(t) >= 3) | t.rlike("^[0-9]{2,4}$")) & ~t.isin(stop))


def link_token_set(c: Column | str, stop: list[str]) -> Column:
    """The distinct ``link_tokens``; a repeated word is stemmed once."""
    stemmed = F.transform(F.array_distinct(tokens(question_normalise(c))), stem)
    return F.array_distinct(F.filter(stemmed, lambda t: ((F.length(t) >= 3) | t.rlike("^[0-9]{2,4}$")) & ~t.isin(stop)))


def signature(toks: Column) -> Column:
    """Ordered distinct tokens joined."""
    return F.array_join(F.sort_array(F.array_distinct(toks)), " ")


def fuzzy_key(c: Column | str, gap: str = "") -> Column:
    """Grouping key: punctuation to ``gap``, blanks to one space."""
    t = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", gap)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_blank(c: Column | str) -> Column:
    """Straight quotes, and one space for every run of white space."""
    t = F.regexp_replace(F.regexp_replace(text(c), "[‘’]", "'"), "[“”]", '"')
    return F.trim(F.regexp_replace(t, f"{BLANK}+", " "))


def scrub(c: Column | str) -> Column:
    """URLs, e-mail addresses and phone-like runs out."""
    t = F.regexp_replace(text(c), r"https?://[^\s]+", " ")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " ")
    t = F.regexp_replace(t, r"[+]?[0-9][0-9 ()-]{8,}[0-9]", " ")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def html_to_text(c: Column | str) -> Column:
    """Scripts and comments out, block ends to new lines, tags out, entities decoded, blank runs collapsed."""
    t = F.regexp_replace(text(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br */?>|</(p|div|li|tr|h[1-6])>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def slug(c: Column | str, size: int = 120, default: str = "q") -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, size), F.lit("")), F.lit(default))


def title_case(c: Column | str) -> Column:
    """Upper case at ASCII word starts, the rest lower."""
    parts = F.split(F.lower(text(c)), r"(?<![a-z0-9])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def clip(c: Column | str, size: int, at: str = " ") -> Column:
    """At most ``size`` characters, cut at the last ``at`` if that is past the half, with ``...``."""
    t = text(c)
    head = F.substring(t, 1, size)
    last = F.length(head) - F.instr(F.reverse(head), at)
    cut = F.when((F.instr(head, at) > 0) & (last > size / 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def stable_id(prefix: str, size: int, *parts: Column | str) -> Column:
    joined = F.concat_ws("|", *[text(p if isinstance(p, Column) else F.col(p).cast("string")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, size))


def hash_pick(values: list[str], seed: Column | str) -> Column:
    """One of ``values``, by the first eight hex digits of the seed's digest."""
    n = F.conv(F.substring(F.sha2(text(seed), 256), 1, 8), 16, 10).cast("long")
    return F.element_at(F.lit(values), (n % len(values) + 1).cast("int"))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text(c), F.lit("[A-Za-z0-9_]+")).cast("long")


def first_contained(c: Column | str, words: list[str]) -> Column:
    """First of ``words``, in their order, that the lower-cased text contains; null if none."""
    t = F.lower(text(c))
    return F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in words])


def classify(c: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(text(c).rlike(pattern), label).otherwise(out)
    return F.coalesce(out, F.lit(default))


def most_hits(c: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """Label with most hits of its pattern; ties go to the earlier one."""
    hits = F.array(*[F.struct(F.regexp_count(text(c), F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (label, p) in enumerate(rules)])
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["label"]).otherwise(F.lit(default))


def question_lines(c: Column | str, low: int, high: int, words: list[str], skip: list[str] | None = None, most: int = 80, cut: int = 260) -> Column:
    """Lines of ``low`` to ``high`` characters that say their marks, or have a number in front and one of the ``words``; none with a pattern of ``skip``, such as a
    header's. One space for white space, ``cut`` characters at most, each line once whatever its case; the first ``most``."""
    begin, end = "(?<![a-z0-9_])", "(?![a-z0-9_])"
    lines = F.transform(F.split(text(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    number = r"^(?:(?:q\.?\s*)?[0-9]{1,2}\s*(?:[.)]|\([a-e]\)|[a-e][.)])|\([a-e]\))\s"

    def hit(x: Column) -> Column:
        t = F.lower(x)
        said = t.rlike(rf"{begin}[0-9]{{1,3}}\s*marks?{end}") | (t.rlike(number) & t.rlike(rf"{begin}(?:{'|'.join(words)}){end}"))
        return F.length(x).between(low, high) & said & (~t.rlike("|".join(skip)) if skip else F.lit(True))

    kept = F.transform(F.filter(lines, hit), lambda x: F.substring(x, 1, cut))
    first = lambda xs: once(F.transform(xs, lambda x: F.lower(x)), lambda lows: F.filter(xs, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1))
    return F.slice(once(kept, first), 1, most)


def lenient_int(c: Column | str) -> Column:
    """Leading digits as an integer, else null."""
    return F.regexp_extract(text(c), r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")


def listed(c: Column | str, mark: str = ",") -> Column:
    """Trimmed, non-empty items of a separated list."""
    return F.filter(F.transform(F.split(text(c), mark), lambda x: F.trim(x)), lambda x: x != "")


def round_half_up(c: Column, places: int) -> Column:
    return F.floor(c * 10**places + 0.5) / F.lit(float(10**places))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal, or one of four or more characters inside the other, or within one edit (two if the longer has over five)."""
    longest = F.greatest(F.length(a), F.length(b))
    near = F.when(longest <= 5, F.levenshtein(a, b, 1) >= 0).otherwise(F.levenshtein(a, b, 2) >= 0)
    return (a == b) | (a.contains(b) & (F.length(b) >= 4)) | (b.contains(a) & (F.length(a) >= 4)) | near


def token_score(term: Column, toks: Column) -> Column:
    """Best of: 1 for an equal token, 0.82 where one holds the other, else 1 - distance / length, 0.4 at least."""
    one = lambda t: (
        F.when(t == term, 1.0).when(t.contains(term) | term.contains(t), 0.82)
        .otherwise(F.greatest(F.lit(0.4), 1 - F.levenshtein(t, term) / F.greatest(F.length(t), F.length(term))))
    )
    return F.coalesce(F.array_max(F.transform(toks, one)), F.lit(0.0))
