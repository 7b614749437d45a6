"""Quality gates on texts, names, links and values: Column to boolean Column; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Word boundaries among ASCII characters.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Cells that say nothing.
EMPTY_VALUES = ["", "na", "n/a", "-", "--", "none", "nil", "not provided", "not mentioned", "no diagram", "no", "nope", "...", "...."]
NUMBERED = r"(?i)^\s*(?:Q\.?\s*)?[0-9]{1,2}\s*(?:[.)]|\([a-e]\)|[a-e][.)])?\s*"


def clean_public(c: Column | str) -> Column:
    """One space for every run of white space."""
    return F.trim(F.regexp_replace(T.text(c), f"{T.BLANK}+", " "))


def _clean(c: Column | str, clean: Column | None) -> Column:
    return clean_public(c) if clean is None else clean


def publishable(c: Column | str, clean: Column | None = None) -> Column:
    """Not empty, not ``na`` or ``qna``, no bare question number, and eight letters if it begins with q.

    ``clean``: the text as ``clean_public`` leaves it, where a projection of its own has made it already; so for the gates below.
    """
    clean = _clean(c, clean)
    bare = F.regexp_replace(F.lower(clean), r"[\s()\[\].,:;'\"-]+", "")
    few = (F.regexp_count(clean, F.lit("[A-Za-z]")) < 8) & F.lower(clean).startswith("q")
    return ~bare.isin("", "na", "qna") & ~bare.rlike("^q(?:[0-9]+[a-z]?|[a-z])$") & ~few


def useful_question(c: Column | str, clean: Column | None = None) -> Column:
    """Publishable, 24 characters, and four terms unless it has 40 characters."""
    clean = _clean(c, clean)
    return (F.length(clean) >= 24) & publishable(c, clean) & ((F.length(clean) >= 40) | (F.size(T.terms(T.search_normalise(clean))) >= 4))


def linkable(c: Column | str, stop: list[str]) -> Column:
    """Long enough for linking: 32 characters after normalising, and four tokens."""
    return (F.length(T.question_normalise(c)) >= 32) & (F.size(T.link_tokens(c, stop)) >= 4)


def displayable(c: Column | str) -> Column:
    """After its number: 12 characters, three words, and not a word for nothing."""
    t = clean_public(F.regexp_replace(F.regexp_replace(T.text(c), NUMBERED, ""), r"[\[\]]", ""))
    return (F.length(t) >= 12) & ~t.rlike(r"(?i)^(?:na|qna|n/a|null|undefined)(?: na)?$") & (F.size(F.split(t, " ")) >= 3)


def junk_value(c: Column | str, skip: list[str] = EMPTY_VALUES) -> Column:
    """Null, in ``skip``, or begins with ``not``."""
    low = F.lower(F.trim(T.text(c)))
    return low.isin(skip) | low.startswith("not ")


def publishable_link(kind: Column | str, confidence: Column | str) -> Column:
    """By match type: direct ones always, strong ones from 0.68, topic ones from 0.3."""
    k, x = T.text(kind), F.col(confidence) if isinstance(confidence, str) else confidence
    ok = k.isin("direct", "exact") | (k.isin("strong", "high-confidence") & (x >= 0.68)) | (k.isin("topic-match", "loose-topic-match", "reasoned") & (x >= 0.3))
    return F.coalesce(ok, F.lit(False))


def usable_source(available: Column | str, page: Column | str, status: Column | str) -> Column:
    """There is a source, a page, and the page is valid or a fallback."""
    a, p = (F.col(x) if isinstance(x, str) else x for x in (available, page))
    return F.coalesce(a, F.lit(False)) & (F.coalesce(p, F.lit(0)) != 0) & T.text(status).isin("valid", "fallback")


def useful_summary(summary: Column | str, status: Column | str) -> Column:
    """Marked available, and 22 words or 160 characters long."""
    clean = T.clean_blank(summary)
    return (T.text(status) == "available") & (clean != "") & ((F.size(F.split(clean, " ")) >= 22) | (F.length(clean) >= 160))


def ranked_enough(elo: Column | str, available: Column | str, least: int = 1400) -> Column:
    """Availability, and a rating of ``least``."""
    e, a = (F.col(x) if isinstance(x, str) else x for x in (elo, available))
    return F.coalesce(a, F.lit(False)) & F.coalesce(e >= least, F.lit(False))


#: What may stand in front of a question's number, with what each is followed by, and the words for a question.
HEADINGS = {"section": "[ab]", "topic": "[0-9]+"}
QUESTION_WORDS = ("question", "q")
NUMBER = "[0-9]+[a-z]?"


def _question_number(words: tuple[str, ...]) -> str:
    return rf"(?:{'|'.join(words)})\.?\s*{NUMBER}"


def prompt_normalise(c: Column | str, headings: dict[str, str] = HEADINGS, words: tuple[str, ...] = QUESTION_WORDS, clean: Column | None = None) -> Column:
    """A prompt without what stands in front of it: a heading with its number, a question's number, a bare number; and without quotes and marks."""
    heading = "|".join(rf"{word}\s+{what}\s+" for word, what in headings.items())
    quotes = "[\"“”']+"
    t = F.lower(_clean(c, clean))
    for front in (rf"(?:{heading})?{_question_number(words)}\)?\s*", rf"{NUMBER}[.)]\s*", quotes):
        t = F.regexp_replace(t, f"^{front}", "")
    t = F.translate(F.regexp_replace(t, f"{quotes}$", ""), "'\"`", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def rejected_prompt(
    c: Column | str, openings: list[str], longest: int = 180, words: tuple[str, ...] = QUESTION_WORDS, clean: Column | None = None, normal: Column | None = None
) -> Column:
    """Empty, several question numbers, longer than ``longest``, or one of the ``openings`` (patterns). ``normal``: as ``prompt_normalise`` leaves it, if made already."""
    n = prompt_normalise(c, words=words, clean=clean) if normal is None else normal
    numbers = F.regexp_count(F.lower(_clean(c, clean)), F.lit(f"{BEGIN}{_question_number(words)}{END}"))
    return (n == "") | (numbers > 1) | (F.length(n) > longest) | n.rlike(f"^(?:{'|'.join(openings)})")


def prompt_like(c: Column | str, toks: Column, blocked: list[str], longest: int = 180, most: int = 20, clean: Column | None = None) -> Column:
    """A prompt: not longer than ``longest``, one to ``most`` tokens, no blocked opening, eight characters after normalising."""
    clean = _clean(c, clean)
    return (
        (clean != "") & (F.length(clean) <= longest) & F.size(toks).between(1, most) & ~clean.rlike(f"(?i)^(?:{'|'.join(blocked)})")
        & (F.length(T.question_normalise(clean)) >= 8)
    )


def person_like(c: Column | str, not_a_person: list[str]) -> Column:
    """Three letters, none of the patterns, and no short code in capitals and digits."""
    t = T.text(c)
    letters = F.regexp_count(t, F.lit("[A-Za-z]"))
    code = t.rlike(r"^[A-Z0-9\s_-]{3,}$") & (letters < 5)
    return (F.length(t) >= 3) & (letters >= 3) & ~F.trim(t).rlike(f"(?i)(?:{'|'.join(not_a_person)})") & ~code


def plausible_name(key: Column | str, bad: list[str]) -> Column:
    """A name key of one to four words, a single one of four letters, none of them ``bad``."""
    words = F.filter(F.split(T.text(key), r"\s+"), lambda w: w != "")
    return F.size(words).between(1, 4) & ((F.size(words) > 1) | (F.length(F.get(words, 0)) >= 4)) & ~F.exists(words, lambda w: w.isin(bad))


def complete(question: Column | str, person: Column | str) -> Column:
    """Both are there."""
    return (F.trim(T.text(question)) != "") & (F.trim(T.text(person)) != "")


def text_quality(c: Column | str, clean: Column | None = None) -> Column:
    """3 for marks, 2 without an answer length, 2 for one question number at most, 1 for 220 characters at most."""
    t = _clean(c, clean)
    points = [
        (t.rlike(rf"(?i){BEGIN}marks?{END}"), 3), (~t.rlike(rf"(?i){BEGIN}answer in [0-9]+ words?{END}"), 2),
        (F.regexp_count(t, F.lit(rf"(?i){BEGIN}q(?:uestion)?\.?\s*[0-9]+")) <= 1, 2), (F.length(t) <= 220, 1),
    ]
    return sum((F.when(ok, n).otherwise(0) for ok, n in points), F.lit(0))


def instruction_segment(c: Column | str, openings: list[str]) -> Column:
    """Begins with one of the ``openings`` (patterns) as a whole word."""
    return F.trim(T.text(c)).rlike(f"(?i)^(?:{'|'.join(openings)}){END}")
