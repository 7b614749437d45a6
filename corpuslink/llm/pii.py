"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, and a classifier trained on that decides.

Candidates are all spans of the base patterns and of looser ones (addresses written out with "at" and "dot", IPv6, numbers without a plus,
cards of other lengths or with a wrong check digit, names). Five labelers vote +1, -1 or not at all on each: strict form, gazetteer
(top-level domains, issuer and country prefixes, reserved networks, given names and titles), words of the context before it, what
it touches, and variety of its characters. Distinct patterns of votes are few (kinds times 3**5, whatever the corpus);
expectation-maximisation over their counts estimates each labeler's reliability and each kind's share (Dawid and Skene), within
one row and one expression. Each pattern's posterior then labels, softly, the training of a logistic regression over
votes and shape, and the regression decides on every span. Base spans stay in any case.

Every step is a DataFrame or SQL expression; nothing runs in Python on executors. Candidates are found inside a row, so there is no shuffle
but those of the pattern counts, which are summed before it. Patterns are written so that they run in time linear in the text: a
run of characters is entered at its start alone and never given back. A start offset costs the number of matches before it.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; a text of any length is scanned whole; where
two added spans overlap, the likelier one stays, then the earlier kind; keys may be of any type; an empty table gives an empty
table, and no candidates no classifier; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "name")
LABELERS, ROUNDS, KEPT = 5, 40, 0.5
BEFORE, AFTER = 48, 8

# Common top-level domains, given names, titles, and words that speak for or against a kind.
DOMAINS = "com org net edu gov info biz io eu de at ch fr be es it nl uk us ca au mx ar br pt pl se no dk fi ie in jp".split()
NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Peter Paul Mark George Anna Emma Laura Julia Hans Klaus Jürgen Wolfgang Stefan Ursula Monika Petra Sabine Heike Pierre Jean Michel Philippe "
    "Marie Nathalie Isabelle Sylvie Catherine José Juan Carlos Luis Antonio Manuel María Carmen Josefa Isabel Ana"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Don Doña".split()
FOR = {
    "email": "mail email e-mail contact write kontakt courriel correo reply",
    "ip": "ip address host server client login adresse servidor",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono whatsapp",
    "name": "name signed sincerely dear regards author by patient client nombre nom",
}
AGAINST = "version v release section chapter isbn issn doi order invoice page figure table serial build model"

EMAIL_RUN, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
STRICT_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def n_digits(v: Column) -> Column:
    return F.length(digits(v))


def luhn(v: Column) -> Column:
    """The check digit of the digits in ``v``, at most 19, is right."""
    d = F.substring(digits(v), 1, 20)
    twice = lambda i: 2 * F.substring(d, -i, 1).cast("int")
    worth = lambda i: F.when(i % 2 == 1, F.substring(d, -i, 1).cast("int")).otherwise(twice(i) - F.when(twice(i) > 9, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


@dataclass(frozen=True)
class Source:
    """One pattern: which of its matches are base spans, which more are candidates; texts without ``needs`` aren't searched."""

    name: str
    kind: str
    pattern: str
    base: Callable[[Column], Column] | None
    also: Callable[[Column], Column] | None = None
    needs: tuple[str, ...] = ()


SOURCES = (
    # A run is entered at its start, or where the match before ended; from the middle it would match or fail just the same.
    Source("email", "email", rf"(?:(?<!{EMAIL_RUN})|\G){EMAIL_RUN}++@{DOMAIN}++(?:\.{DOMAIN}++)++", lambda v: F.lit(True), needs=("@",)),
    Source("ip", "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), needs=(".",)),
    Source(
        "card", "card", r"[0-9](?:[\x20-]?[0-9])++",
        lambda v: n_digits(v).between(16, 19) & luhn(v),
        lambda v: (n_digits(v).between(13, 15) & luhn(v)) | ((n_digits(v) == 16) & ~luhn(v)),
    ),
    Source("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: n_digits(v).between(8, 15), needs=("+",)),
    Source(
        "spelt", "email",
        rf"(?:(?<!{EMAIL_RUN})|\G){EMAIL_RUN}++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20){DOMAIN}++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20){DOMAIN}++)++",
        None, lambda v: F.lit(True), needs=("at)", "at]", " dot "),
    ),
    Source("ipv6", "ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", None, lambda v: F.lit(True), needs=(":",)),
    Source(
        "local", "phone", r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
        None, lambda v: n_digits(v).between(8, 15), needs=("-", "."),
    ),
    Source(
        "name", "name", r"(?<!\p{L})\p{Lu}\p{Ll}++\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+",
        None, lambda v: F.regexp_extract(v, r"^\p{L}+", 0).isin(*NAMES, *TITLES),
    ),
)


def found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key and, per source, its spans (start, end, v, before, after, base), each list in its own column."""
    t = F.col("t")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    here = lambda s: (F.lit(True) if not s.needs else F.array_contains(F.array(*[F.contains(t, F.lit(x)) for x in s.needs]), True))
    rows = rows.select("key", "t", *[F.when(here(s), F.regexp_extract_all("t", F.lit(s.pattern), 0)).otherwise(none).alias(f"v_{s.name}") for s in SOURCES])
    yes = lambda f, v: F.lit(False) if f is None else f(v)

    def wanted(s: Source) -> Column:
        """(place, is base) of the matches that count."""
        place = F.when(F.size(f"v_{s.name}") > 0, F.sequence(F.lit(0), F.size(f"v_{s.name}") - 1)).otherwise(F.array().cast("array<int>"))
        judged = F.transform(place, lambda i: F.struct(i.alias("i"), yes(s.base, F.get(f"v_{s.name}", i)).alias("base"), yes(s.also, F.get(f"v_{s.name}", i)).alias("also")))
        return F.filter(judged, lambda x: x["base"] | x["also"]).alias(f"w_{s.name}")

    rows = rows.select("*", *[wanted(s) for s in SOURCES])
    # The text between matches, only where one counts.
    rows = rows.select("*", *[F.when(F.size(f"w_{s.name}") > 0, F.split("t", s.pattern, -1)).otherwise(none).alias(f"g_{s.name}") for s in SOURCES]).drop("t")
    sizes = [F.zip_with(f"g_{s.name}", f"v_{s.name}", lambda g, v: F.struct(F.length(g).alias("g"), F.coalesce(F.length(v), F.lit(0)).alias("v"))).alias(f"n_{s.name}") for s in SOURCES]
    rows = rows.select("*", *sizes)

    def spans(s: Source) -> Column:
        def span(x: Column) -> Column:
            v, gap = F.get(f"v_{s.name}", x["i"]), F.get(f"g_{s.name}", x["i"])
            start = F.aggregate(F.slice(f"n_{s.name}", 1, x["i"] + 1), F.lit(0), lambda a, n: a + n["g"] + n["v"]) - F.length(v)
            return F.struct(
                start.alias("start"), (start + F.length(v)).alias("end"), v.alias("v"), F.substring(gap, -BEFORE, BEFORE).alias("before"),
                F.substring(F.get(f"g_{s.name}", x["i"] + 1), 1, AFTER).alias("after"), x["base"].alias("base"),
            )

        return F.transform(f"w_{s.name}", span).alias(s.name)

    return rows.select("key", *[spans(s) for s in SOURCES])


def vote(yes: Column, no: Column) -> Column:
    """2 for, 0 against, 1 no vote: places in a labeler's table of reliabilities."""
    return F.when(F.coalesce(no, F.lit(False)), 0).when(F.coalesce(yes, F.lit(False)), 2).otherwise(1)


def known_domain(v: Column) -> Column:
    return F.lower(F.regexp_extract(v, "(?<![A-Za-z0-9-])[A-Za-z0-9-]++$", 0)).isin(*DOMAINS)


def strict(kind: str, v: Column) -> Column:
    if kind == "email":
        good = v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$")
        spelt = ~F.contains(v, F.lit("@"))
        return vote(good | (spelt & v.rlike(r"[)\]]")), ~good & (~spelt | ~known_domain(v)))
    if kind == "ip":
        good = v.rlike(rf"^{STRICT_OCTET}(?:\.{STRICT_OCTET}){{3}}$") | F.contains(v, F.lit(":"))
        return vote(good, ~good)
    if kind == "card":
        good = luhn(v)
        return vote(good, ~good)
    if kind == "phone":
        return vote(F.startswith(v, F.lit("+")) | F.startswith(v, F.lit("00")), F.lit(False))
    return vote(F.size(F.split(v, " ")) == 3, F.lit(False))


def gazetteer(kind: str, v: Column) -> Column:
    if kind == "email":
        return vote(known_domain(v), ~known_domain(v))
    if kind == "ip":
        reserved = v.rlike(r"^0*(?:0|127|2[4-9][0-9])\.")
        return vote(~reserved, reserved)
    if kind == "card":
        known = digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[0-8]|6)")
        return vote(known, ~known)
    if kind == "phone":
        return vote(v.rlike(r"^(?:\+|00)(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), F.lit(False))
    return vote(F.regexp_extract(v, r"\p{L}+", 0).isin(*NAMES), F.lit(False))


def context(kind: str, before: Column) -> Column:
    words = lambda x: rf"(?iu)(?<![\p{{L}}]){'(?:' + '|'.join(x.split()) + ')'}(?![\p{{L}}])[^\n]{{0,24}}$"
    return vote(before.rlike(words(FOR[kind])), before.rlike(words(AGAINST)))


def touching(before: Column, after: Column) -> Column:
    bad = before.rlike(r"[\p{L}\p{N}_/=.-]$") | after.rlike(r"^[\p{L}\p{N}_/=@]")
    return vote(~bad, bad)


def variety(kind: str, v: Column) -> Column:
    chars = lambda x, least: F.size(F.array_distinct(F.split(x, ""))) >= least
    good = chars(F.lower(v), 6) if kind in ("email", "name") else chars(digits(v), 4) | F.contains(v, F.lit(":"))
    return vote(good, ~good)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and its candidate spans, as an array of (kind, start, end, value, base, votes, shape); added ones that touch a base span are left out."""

    def judged(s: Source) -> Column:
        def one(x: Column) -> Column:
            votes = F.array(
                strict(s.kind, x["v"]), gazetteer(s.kind, x["v"]), context(s.kind, x["before"]), touching(x["before"], x["after"]), variety(s.kind, x["v"])
            )
            shape = F.array(
                F.least(F.length(x["v"]), F.lit(31)).cast("int").bitwiseAND(28), F.endswith(x["before"], F.lit(" ")).cast("int"),
                x["before"].rlike("[:=(<\"']\\s?$").cast("int"), x["after"].rlike(r"^[\s,;.!?)>]|^$").cast("int"),
            )
            return F.struct(
                F.lit(KINDS.index(s.kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["v"].alias("value"), x["base"].alias("base"), votes.alias("votes"), shape.alias("shape")
            )

        return F.transform(s.name, one)

    rows = found(docs, key, text).select("key", F.concat(*[judged(s) for s in SOURCES]).alias("c"))
    rows = rows.select("key", "c", F.filter("c", lambda x: x["base"]).alias("b"))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    free = F.filter("c", lambda x: x["base"] | ~F.exists("b", lambda y: meets(x, y)))
    return rows.select("key", F.when(F.size("b") > 0, free).otherwise(F.col("c")).alias("c"))


def estimated(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Distinct votes (kind, votes, n) with ``posterior``, by expectation-maximisation over their counts.

    The patterns (at most kinds times 3**labelers) stand in one row; its fold over the rounds carries the share of true spans of each kind and, for
    true and false spans, each labeler's three rates.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", F.col("n").cast("double").alias("n")))).alias("p"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def maximised(q: Column) -> Column:
        """Smoothed rates from spans (kind, votes, y: weight of true, z: of false)."""
        rates = lambda side: F.transform(
            F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)),
            lambda c: (1 + total(q, lambda x: F.when(F.get(x["votes"], F.floor(c / 3).cast("int")) == c % 3, x[side]).otherwise(0.0))) / (3 + total(q, lambda x: x[side])),
        )
        share = F.transform(
            F.sequence(F.lit(0), F.lit(len(KINDS) - 1)),
            lambda k: (1 + total(q, lambda x: F.when(x["kind"] == k, x["y"]).otherwise(0.0))) / (2 + total(q, lambda x: F.when(x["kind"] == k, x["y"] + x["z"]).otherwise(0.0))),
        )
        return F.struct(share.alias("share"), rates("y").alias("y"), rates("z").alias("z"))

    def split(p: Column, of: Callable[[Column], Column]) -> Column:
        return F.transform(p, lambda x: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), (x["n"] * of(x)).alias("y"), (x["n"] * (1 - of(x))).alias("z")))

    def posterior(s: Column, x: Column) -> Column:
        yes, no = F.get(s["share"], x["kind"]), 1 - F.get(s["share"], x["kind"])
        for j in range(LABELERS):
            at = 3 * j + F.get(x["votes"], F.lit(j))
            yes, no = yes * F.get(s["y"], at), no * F.get(s["z"], at)
        return yes / (yes + no)

    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    lean = lambda x: F.aggregate(x["votes"], F.lit(0), lambda a, v: a + v - 1)
    majority = lambda x: F.when(lean(x) > 0, 0.9).when(lean(x) < 0, 0.1).otherwise(0.5)
    begun = one.select("p", let(split(F.col("p"), majority), maximised).alias("s"))
    step = lambda s, _: let(split(F.col("p"), lambda x: posterior(s, x)), maximised)
    ended = begun.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("s"), step).alias("s"))
    return ended.select("s", F.explode("p").alias("x")).select("x.kind", "x.votes", "x.n", posterior(F.col("s"), F.col("x")).alias("posterior"))


def features(kind: Column, votes: Column, shape: Column) -> dict[str, Column]:
    held = {f"is_{k}": (kind == i).cast("double") for i, k in enumerate(KINDS)}
    held |= {f"vote_{j}": (F.get(votes, F.lit(j)) - 1).cast("double") for j in range(LABELERS)}
    held |= {f"shape_{j}": F.get(shape, F.lit(j)) / (32.0 if j == 0 else 1.0) for j in range(4)}
    return held


def trained(spans: DataFrame) -> Callable[[Column], Column] | None:
    """Probability of a span (kind, votes, shape), learned from the posteriors of its votes; None without spans."""
    counts = spans.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n"))
    counts = stored(counts, "span_patterns")  # at most patterns of votes times 64 shapes
    if counts.isEmpty():
        return None
    known = estimated(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n"))).drop("n")
    rows = counts.join(F.broadcast(known), ["kind", "votes"])
    table = features(F.col("kind"), F.col("votes"), F.col("shape"))
    both = rows.select(*[c.alias(n) for n, c in table.items()], "n", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("posterior").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("posterior")).alias("w")))).alias("x"))
    both = VectorAssembler(inputCols=[*table], outputCol="f").transform(both).select("f", "x.y", (F.col("n") * F.col("x.w")).alias("w"))
    model = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.001, maxIter=50, standardization=False).fit(both)
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)

    def probability(x: Column) -> Column:
        z = F.lit(bias)
        for w, f in zip(weights, features(x["kind"], x["votes"], x["shape"]).values(), strict=True):
            z = z + w * f
        return 1 / (1 + F.exp(-z))

    return probability


def detected(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: float = KEPT) -> DataFrame:
    """Per row: key and ``spans``, an array of (kind, start, end, value, base, probability), by kind, then start."""
    found_ = stored(candidates(docs, key, text), "candidates")
    probability = trained(found_.select(F.explode("c").alias("x")).select("x.kind", "x.votes", "x.shape"))
    p = probability or (lambda x: F.lit(0.0))
    scored = F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["base"].alias("base"), p(x).alias("probability")))
    rows = found_.select("key", scored.alias("s")).select("key", F.filter("s", lambda x: x["base"] | (x["probability"] >= kept)).alias("s"))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    before = lambda x, y: (y["probability"] > x["probability"]) | ((y["probability"] == x["probability"]) & ((y["kind"] < x["kind"]) | ((y["kind"] == x["kind"]) & (y["start"] < x["start"]))))
    rest = F.filter("s", lambda x: x["base"] | ~F.exists("s", lambda y: ~y["base"] & meets(x, y) & before(x, y)))
    return rows.select(F.col("key").alias(key), F.sort_array(rest).alias("spans"))


def digested(found_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``detected``: key, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, spans as text, n_added."""
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["base"])
    n = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return found_.select(
        key, *[n(k) for k in KINDS[:4]], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    )
