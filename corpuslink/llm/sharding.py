"""Sharding by balanced label propagation.

Documents start in the shard of their id's hash. Linked documents (here: equal texts, joined through a hub a group) move, round
by round, to the shard with room that most of their neighbours are in; a group larger than the room there takes as many of its next best shards
as it needs. Loads and quotas are 40-row tables. ``ROUNDS`` rounds are made, fewer if nothing moves. In the end, a shard keeps as many documents
as the law ``rows`` gives it - linked ones before single ones - and what is over fills the gaps elsewhere, so counts differ by one at most.

Places are distributed ranks: counts by (shard, bucket of hashes) are added up, and rows are numbered inside a bucket. Members of a group are
dealt to SPREAD salts: counts, votes and decisions are made for (group, salt, shard) and joined on them, so a hot group is many keys.

Defined results: null text has size 16, equals the empty text and is linked with it; repeated rows are documents of their own; null ids have a shard
like others; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SHARDS, ROUNDS, BUCKETS, SPREAD = 40, 6, 64, 16


def ranked(rows: DataFrame, by: str, order: Column, spread: Column, last: list[str]) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2 ... within ``by``, by (order, spread, last); order and spread are small integers."""
    rows = rows.withColumn("_o", order).withColumn("_s", spread)
    part = Window.partitionBy(by).orderBy("_o", "_s")
    counts = rows.groupBy(by, "_o", "_s").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(part) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_o", "_s").orderBy(*last)) - 1
    numbered = rows.withColumn("_i", inside)
    return numbered.join(starts, [by, "_o", "_s"]).withColumn("place", F.col("_start") + F.col("_i")).drop("_o", "_s", "_i", "_start")


def bucket(c: Column, n: int, seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")


def decisions(rows: DataFrame, cap: int) -> DataFrame:
    """(grp, salt, shard, wish): which members of a group go where; ``rows`` are linked ones."""
    part = rows.groupBy("grp", "salt", "shard").agg(F.count("*").alias("n"), F.max("members").alias("members"))
    votes = part.groupBy("grp", "shard").agg(F.sum("n").alias("n"), F.max("members").alias("members"))
    room = part.groupBy("shard").agg(F.greatest(F.lit(0), F.lit(cap) - F.sum("n")).alias("room"))  # single documents make room in the end
    # The best shards that hold the group together, with the members they have; the others' members go to those of them with room.
    best = Window.partitionBy("grp").orderBy(F.desc("n"), F.desc(F.col("room") > 0), F.xxhash64("grp", "shard"))
    ranked_ = votes.join(F.broadcast(room), "shard").withColumn("top", F.sum("room").over(best)).withColumn("holds", F.sum(F.col("room") + F.col("n")).over(best))  # a row a shard is sent
    ranked_ = ranked_.withColumn("home", F.col("holds") - F.col("room") - F.col("n") < F.col("members"))
    to = ranked_.filter("home and room > 0").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("top", "shard"))).alias("to"))  # at most a shard each
    leaving = ranked_.filter("not home").join(to, "grp")
    moving = part.select("grp", "salt", "shard").join(leaving.select("grp", "shard", "to"), ["grp", "shard"])
    at = F.pmod(F.xxhash64(F.lit("to"), "grp", "salt", "shard"), F.lit(10_000)) / 10_000 * F.element_at("to", -1)["top"]
    return moving.select("grp", "salt", "shard", F.filter("to", lambda x: x["top"] > at)[0]["shard"].alias("wish"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, size, text_crc32, group, shard, slot."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h")
    ).withColumn("grp", F.xxhash64("size", "crc", "h"))
    ident = F.struct("id", "crc")
    rows = stored(narrow.select("id", "size", "crc", "grp", bucket(ident, SPREAD, "salt").alias("salt"), bucket(ident, shards, "shard").alias("shard")), "rows")
    total = rows.count()
    cap = -(-total // shards)
    # Only groups with two rows or more have links.
    parts = rows.groupBy("grp", "salt").agg(F.count("*").alias("n"))
    linked = parts.groupBy("grp").agg(F.sum("n").alias("members")).filter("members > 1")
    linked = stored(parts.select("grp", "salt").join(linked, "grp"), "groups")
    names = ["id", "size", "crc", "grp", "salt", "shard", "members"]
    rows = stored(rows.join(linked, ["grp", "salt"], "left").withColumn("members", F.coalesce("members", F.lit(1))).select(*names), "rows")
    for _ in range(rounds):
        moving = stored(decisions(rows.filter("members > 1"), cap), "moving")
        if moving.isEmpty():
            break
        both = rows.join(moving, ["grp", "salt", "shard"], "left")
        room = rows.filter("members > 1").groupBy("shard").agg((F.lit(cap) - F.count("*")).alias("room")).withColumnRenamed("shard", "wish")
        going = both.filter("wish is not null")
        placed = ranked(going, "wish", bucket(F.col("grp"), BUCKETS, "order"), bucket(F.struct("id", "shard"), SPREAD, "spread"), ["grp", "id", "crc"])
        there = F.when(F.col("place") < F.coalesce("room", F.lit(cap)), F.col("wish")).otherwise(F.col("shard"))
        decided = placed.join(F.broadcast(room), "wish", "left").withColumn("shard", there)  # a row a shard is sent
        new = stored(both.filter("wish is null").select(*names).union(decided.select(*names)), "rows")
        discard(rows, moving)
        rows = new
    return _settled(rows, total, shards).select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "grp", "shard", "slot")


def _settled(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Counts at most one apart: shard s keeps its quota, single documents leave first and fill the gaps in order."""
    base, over = divmod(total, shards)
    order = F.when(F.col("members") > 1, 0).otherwise(BUCKETS) + bucket(F.col("grp"), BUCKETS, "order")
    placed = stored(ranked(rows, "shard", order, bucket(F.struct("id", "size"), SPREAD, "spread"), ["grp", "id", "crc"]), "placed")
    quota = F.lit(base) + F.when(F.col("shard") < over, 1).otherwise(0)
    loads = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    gaps, excess, g, e = [], [], 0, 0
    for s in range(shards):
        q, n = base + (s < over), loads.get(s, 0)
        if n < q:
            gaps.append((s, g, g + q - n, n))
            g += q - n
        elif n > q:
            excess.append((s, e - q))
            e += n - q
    keep = placed.filter(F.col("place") < quota).select("id", "size", "crc", "grp", "shard", F.col("place").alias("slot"))
    if not gaps:
        return keep
    pairs = [F.lit(x) for pair in excess for x in pair]  # at most a pair a shard
    turn = F.col("place") + F.element_at(F.create_map(*pairs), F.col("shard"))
    moved = placed.filter(F.col("place") >= quota).withColumn("turn", turn)
    gap = F.filter(F.lit([list(x) for x in gaps]), lambda x: (F.col("turn") >= x[1]) & (F.col("turn") < x[2]))[0]
    moved = moved.withColumn("gap", gap)
    return keep.union(
        moved.select("id", "size", "crc", "grp", F.col("gap")[0].cast("int").alias("shard"), (F.col("gap")[3] + F.col("turn") - F.col("gap")[1]).alias("slot"))
    )
