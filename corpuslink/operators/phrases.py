"""Tagging texts from a large dictionary: phrases are a table, found by an equal join instead of one scan of the text for each.

``phrase_hits`` finds whole-token phrases: each phrase is keyed by its rarest token, rows are joined on that token, and the phrase is
checked by position in the few tokens around it, which come along. ``alias_hits`` finds any substring: each alias is keyed by its
rarest run of ``GRAM`` characters, rows are joined on the runs they hold, and the text is checked once for each alias left.
So work follows the occurrences of rare keys; the number of phrases only grows the small side. A phrase all of whose tokens are frequent is
keyed by the least frequent of them: its hits are many then, too.

Defined results: null texts, phrases and aliases match nothing; a phrase is found once a row; of phrases equal after normalising the
first by ``ord`` stays; repeated ids are rows of one id; an empty dictionary or table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import first_per_key, top_per_group
from .positional import blocks_of

GRAM = 4
#: Characters of text in a block of ``alias_tags``, and aliases that meet it at once.
TEXT_CHARS, PIECE = 16_000_000, 500_000


def _rarest(parts: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Of each phrase the part that fewest rows hold; parts that no row holds can't match at all and come first."""
    known = parts.join(counts, key, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return known.groupBy("ord").agg(F.min_by(F.struct(key, "off"), F.struct("df", "off", key)).alias("k")).select("ord", f"k.{key}", "k.off")


def phrase_hits(rows: DataFrame, dictionary: DataFrame, ident: str, toks: str, phrase: str) -> DataFrame:
    """(ident, ord, start): phrases of ``dictionary`` (ord, ``phrase``: array of tokens) that the row's token array holds in a row, with their first place from 0."""
    words = first_per_key(dictionary.filter(F.size(phrase) > 0).select("ord", F.col(phrase).alias("want")), ["want"], ["ord"])
    longest = (words.agg(F.max(F.size("want"))).first()[0] or 1) - 1  # one number
    keys = words.select("ord", F.posexplode("want").alias("off", "token"))
    held = rows.select(F.explode(F.array_distinct(toks)).alias("token")).join(keys.select("token").distinct(), "token", "left_semi")
    chosen = _rarest(keys, held.groupBy("token").agg(F.count("*").alias("df")), "token").join(words, "ord")
    around = F.transform(toks, lambda t, i: F.struct(t.alias("token"), i.alias("i"), F.slice(toks, F.greatest(F.lit(1), i + 1 - longest), F.least(i, F.lit(longest)) + 1 + longest).alias("near")))
    met = rows.select(ident, F.explode(around).alias("x")).select(ident, "x.*").join(chosen, "token")
    begin = F.least(F.col("i"), F.lit(longest)) - F.col("off")  # where the phrase would start in the tokens around
    fits = (begin >= 0) & (F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.size("want")) == F.col("want"))
    return met.filter(fits).groupBy(ident, "ord").agg(F.min(F.col("i") - F.col("off")).cast("int").alias("start"))


def run_hits(rows: DataFrame, dictionary: DataFrame, ident: str, toks: str, phrase: str, sizes: list[int]) -> DataFrame:
    """(ident) and the columns of ``dictionary``: phrases (texts of so many tokens with single spaces) that the row's token array holds in a row, each once.

    Runs of the rows' tokens meet phrases by one equal join, so work is free of how many phrases share a token, and ``dictionary``, if it is made
    by a query, is made once. For a few sizes; ``phrase_hits`` takes all, and tells places.
    """
    words = first_per_key(dictionary.filter(F.size(F.split(phrase, " ")).isin(sizes)), [phrase], ["ord"])

    def of_size(n: int) -> Column:
        spots = F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1)))
        return F.when(F.size(toks) >= n, F.transform(spots, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    runs = F.concat(*[of_size(n) for n in sizes])
    return rows.select(ident, F.explode(F.array_distinct(runs)).alias(phrase)).distinct().join(words, phrase)


def _runs(chars: Column, n: int = GRAM) -> Column:
    """Runs of ``n`` characters, of an array of characters that has as many; a place in an array costs nothing, one in a string a scan."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
    return F.transform(spots, lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)]))


def alias_hits(rows: DataFrame, dictionary: DataFrame, ident: str, text: str, alias: str) -> DataFrame:
    """(ident, ord): aliases of ``dictionary`` (ord, ``alias``) that the row's lower-case text contains, anywhere.

    Aliases shorter than GRAM have no key; they are few by nature (at most the alphabet to the power of three) and are looked up among the row's
    short runs instead.
    """
    low = rows.select(ident, F.lower(text).alias("t"))
    chars = low.filter("t is not null").select(ident, F.split("t", "").alias("c"))
    words = first_per_key(dictionary.filter(F.length(alias) > 0).select("ord", F.lower(alias).alias("want")), ["want"], ["ord"])
    long, short = words.filter(F.length("want") >= GRAM), words.filter(F.length("want") < GRAM)
    keys = long.select("ord", F.posexplode(_runs(F.split("want", ""))).alias("off", "gram"))
    asked = keys.select("gram").distinct()
    each = chars.filter(F.size("c") >= GRAM).select(ident, F.explode(F.array_distinct(_runs(F.col("c")))).alias("gram")).join(asked, "gram", "left_semi")
    chosen = _rarest(keys, each.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    met = each.join(chosen.select("ord", "gram"), "gram").join(long, "ord").groupBy(ident).agg(F.collect_set(F.struct("ord", "want")).alias("w"))
    found = met.join(low, ident).select(ident, F.explode(F.filter("w", lambda x: F.contains(F.col("t"), x["want"]))).alias("x")).select(ident, "x.ord")
    sizes = [r[0] for r in short.select(F.length("want")).distinct().collect()]  # GRAM - 1 at most
    for n in sizes:
        few = chars.filter(F.size("c") >= n).select(ident, F.explode(F.array_distinct(_runs(F.col("c"), n))).alias("want"))
        found = found.unionByName(few.join(short.filter(F.length("want") == n), "want").select(ident, "ord"))
    return found.distinct()


def first_tags(hits: DataFrame, dictionary: DataFrame, ident: str, tag: str, order: list, most: int) -> DataFrame:
    """(ident, tags): distinct tags of a row's hits in the order of their best hit, ``most`` at most. ``order``: Columns on ``dictionary``."""
    return first_named(hits.select(ident, "ord").join(dictionary, "ord"), ident, tag, order, most)


def first_named(named: DataFrame, ident: str, tag: str, order: list, most: int) -> DataFrame:
    """As ``first_tags``, of hits that have the dictionary's columns."""
    place = F.row_number().over(Window.partitionBy(ident, tag).orderBy(*order))
    best = named.withColumn("_r", place).filter("_r = 1")
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy(ident).orderBy(*order))).filter(F.col("_r") <= most)
    return ranked.groupBy(ident).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", tag))), lambda x: x[tag]).alias("tags"))


def _places(runs: np.ndarray, asked: set[int], slot) -> dict[int, np.ndarray]:
    """Where each of ``asked`` stands in ``runs``, rising; ``slot`` puts numbers in a table that tells most others apart."""
    if not asked:
        return {}
    known = np.array(sorted(asked), np.uint32)
    may = np.zeros(int(slot(known).max()) + 1, bool)
    may[slot(known)] = True
    at = slot(runs)
    places = np.flatnonzero(may[np.minimum(at, len(may) - 1)] & (at < len(may)))
    which = np.searchsorted(known, runs[places])
    ok = known[np.minimum(which, len(known) - 1)] == runs[places]
    places, which = places[ok].astype(np.int32), which[ok].astype(np.uint16 if len(known) < 1 << 16 else np.int64)
    places, first = places[np.argsort(which, kind="stable")], np.r_[0, np.cumsum(np.bincount(which, minlength=len(known)))]
    return {int(x): places[first[i] : first[i + 1]] for i, x in enumerate(known)}


def found_in(texts: list[str], wants: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, want) numbers of all wants that a text holds, each once. Wants are looked up by their rarest run of GRAM bytes in all texts together.

    Containment of texts is that of their bytes in UTF-8; the byte between texts is in none.
    """
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\xff".join(parts) + b"\xff" * GRAM, np.uint8)
    last = len(data) - GRAM + 1
    runs = np.zeros(last, np.uint32)
    for i in range(GRAM):
        runs |= data[i : last + i].astype(np.uint32) << np.uint32(8 * i)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + 1 for p in parts])
    number = lambda w: int.from_bytes(w, "little")
    coded = [w.encode() for w in wants]
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(10)
    looked_up = {n: _places(runs & np.uint32((1 << 8 * n) - 1), {number(w) for w in coded if len(w) == n}, lambda x: x) for n in range(1, GRAM)}
    grams = _places(runs, {number(w[i : i + GRAM]) for w in coded for i in range(len(w) - GRAM + 1)}, spread)
    rows, hits = [], []
    for i, w in enumerate(coded):
        if len(w) < GRAM:
            found = looked_up[len(w)][number(w)]
        else:
            spots = [grams[number(w[k : k + GRAM])] for k in range(len(w) - GRAM + 1)]
            off = min(range(len(spots)), key=lambda k: len(spots[k]))
            found = spots[off] - off
            found = found[(found >= 0) & (found + len(w) <= len(data))]
            for k in [*range(off), *range(off + GRAM, len(w))]:
                found = found[data[found + k] == w[k]]
        if len(found):
            at = owner[found]
            at = at[np.r_[True, at[1:] != at[:-1]]]  # places rise, and so do texts
            rows.append(at)
            hits.append(np.full(len(at), i))
    none = np.empty(0, int)
    return (np.concatenate(rows), np.concatenate(hits)) if rows else (none, none)


def _tags_of_block(ident: str, most: int):
    def best(held: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({ident: held[ident].iloc[:0], "n": np.empty(0, int), "found": np.empty(0, object)})
        if not len(held) or not len(words):
            return none
        words = words.sort_values("place", ignore_index=True)
        ids, row_id = np.unique(held[ident].to_numpy(), return_inverse=True)
        row, hit = found_in(held["t"].tolist(), words["want"].tolist())
        if not len(row):
            return none
        pairs = np.unique(row_id[row] * len(words) + hit)  # rising by id, then by place
        who, hit = pairs // len(words), pairs % len(words)
        tag = pd.factorize(words["tag"])[0][hit] + 1  # 0: null
        _, first = np.unique(who * (int(tag.max()) + 1) + tag, return_index=True)
        first = np.sort(first)
        first = first[np.arange(len(first)) - np.searchsorted(who[first], who[first]) < most]
        counts, places, names = np.bincount(who), words["place"].tolist(), words["tag"].tolist()
        lists: dict[int, list] = {}
        for w, h in zip(who[first].tolist(), hit[first].tolist()):
            lists.setdefault(w, []).append({"place": places[h], "tag": names[h]})
        whose = np.array(list(lists))
        return pd.DataFrame({ident: ids[whose], "n": counts[whose], "found": list(lists.values())})

    return best


def alias_tags(rows: DataFrame, dictionary: DataFrame, ident: str, text: str, alias: str, tag: str, order: list, most: int) -> DataFrame:
    """(ident, n, tags): how many aliases of ``dictionary`` (ord, ``alias``, ``tag``) the row's lower-case text contains, and the distinct tags of these by ``order``, ``most`` at most.

    As ``alias_hits`` and ``first_tags``, but texts are dealt in blocks, which meet the dictionary in pieces, and a row a text leaves the task
    instead of a row a hit. ``order``: Columns on ``dictionary``, whose rows it numbers: a dictionary, not the texts. Rows without hits are left out.
    """
    words = first_per_key(dictionary.filter(F.length(alias) > 0).withColumn("want", F.lower(alias)), ["want"], ["ord"])
    words = words.select("want", F.col(tag).alias("tag"), F.row_number().over(Window.orderBy(*order)).alias("place"))
    blocks, pieces = blocks_of(rows, text, TEXT_CHARS), max(1, -(-dictionary.count() // PIECE))  # two numbers
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    held = rows.filter(F.col(text).isNotNull()).select(ident, F.lower(text).alias("t"), F.pmod(F.xxhash64(ident), F.lit(blocks)).alias("block")).withColumn("piece", each(pieces))
    words = words.withColumn("piece", F.pmod(F.xxhash64("want"), F.lit(pieces))).withColumn("block", each(blocks))
    schema = f"{ident} {rows.schema[ident].dataType.simpleString()}, n long, found array<struct<place:int,tag:{dictionary.schema[tag].dataType.simpleString()}>>"
    found = held.groupBy("block", "piece").cogroup(words.groupBy("block", "piece")).applyInPandas(_tags_of_block(ident, most), schema)
    if pieces > 1:
        counts = found.groupBy(ident).agg(F.sum("n").alias("n"))
        one = found.select(ident, F.explode("found").alias("x")).groupBy(ident, F.col("x.tag").alias("tag")).agg(F.min("x.place").alias("place"))
        lists = top_per_group(one, [ident], ["place"], most, "_r").groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("place", "tag"))).alias("found"))
        found = counts.join(lists, ident)
    return found.select(ident, "n", F.transform("found", lambda x: x["tag"]).alias("tags"))
