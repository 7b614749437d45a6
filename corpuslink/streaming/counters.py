"""Quotas, daily activity and upserts as Structured Streaming, each with its batch twin.

Event time comes as TIMESTAMP_NTZ in some tables; watermarks need TIMESTAMP, so ``timed`` casts it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import first_per_key


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def window_hits(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Hits of each key in epoch-aligned windows; the same plan for a stream (update mode) and a table."""
    rows = timed(events, ts)
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("hits")).select(*keys, F.col("w.start").alias("window_start"), "hits")


def quota_flags(events: DataFrame, keys: list[str], order: str, quota: int, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Per event: its number in its window, whether it is within the quota, what remains, and when the window ends."""
    rows = timed(events, ts).withColumn("window_start", F.floor(F.unix_timestamp(ts) / seconds) * seconds)
    n = F.row_number().over(Window.partitionBy(*keys, "window_start").orderBy(ts, order))
    rows = rows.withColumn("hit", n)
    return rows.select(
        *keys, order, "window_start", "hit", (F.col("hit") <= quota).alias("ok"),
        F.greatest(F.lit(0), F.lit(quota) - F.col("hit")).alias("remaining"), (F.col("window_start") + seconds).alias("reset_at"),
    )


def anchored_quota(events: DataFrame, key: str, order: str, quota: int, seconds: float = 60.0, ts: str = "ts") -> DataFrame:
    """Per event: ok. A window opens at the first event after the last one's end; refused events don't extend it.

    Batch twin: rows sorted by key and time pass by in batches; only the key, its count and its window's end are carried, so a key may have any number of events.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, reset = None, 0, float("-inf")
        for batch in batches:
            ok = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last, count, reset = k, 0, float("-inf")
                if t is not None and t >= reset:
                    count, reset = 0, t + seconds
                ok.append(count < quota)
                count += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=[key, order, "ok"])

    rows = timed(events, ts).select(key, order, F.unix_micros(ts).cast("double").alias("us")).withColumn("at", F.col("us") / 1e6).drop("us")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("at"), F.asc_nulls_last(order))
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, ok boolean")


def anchored_quota_stream(events: DataFrame, key: str, order: str, quota: int, seconds: float = 60.0, ts: str = "ts") -> DataFrame:
    """The stream: state a key is a count and an end; idle keys leave by timeout."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, float("-inf"))
        pdf = pd.concat(list(batches)).sort_values(["at", order])
        ok = []
        for t in pdf["at"]:
            if t >= reset:
                count, reset = 0, t + seconds
            ok.append(count < quota)
            count += 1
        state.update((count, reset))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pdf.assign(ok=ok)[[key, order, "ok"]]

    rows = timed(events, ts).select(key, order, (F.unix_micros(ts).cast("double") / 1e6).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {order} {kinds[order]}, ok boolean", "n long, reset double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def daily_activity(events: DataFrame, key: str, weights: dict[str, int], kind: str = "event_type", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, day, n): weighted events a day; kinds without a weight count nothing."""
    weight = F.lit(0)
    for name, w in weights.items():
        weight = F.when(F.col(kind) == name, w).otherwise(weight)
    rows = timed(events, ts).withColumn("_w", weight).filter("_w > 0")
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.sum("_w").alias("n")).select(key, F.to_date("w.start").alias("day"), "n")


def upsert(current: DataFrame, entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write of each key wins; the latest by ``order``."""
    both = current.unionByName(entries)
    return first_per_key(both, keys, [F.desc(c) for c in order])


def upsert_sink(path: str, keys: list[str], order: list[str]):
    """For ``foreachBatch``: merges a batch into the newest version under ``path``; a version is named by its batch, so a repeat is harmless."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{epoch - 1}"
        entries = first_per_key(batch, keys, [F.desc(c) for c in order])
        merged = upsert(spark.read.parquet(old), entries, keys, order) if epoch else entries
        merged.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def unseen(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct items that the cache lacks."""
    return items.select(key).distinct().join(cache.select(key), key, "left_anti")


def reconciled(remote: DataFrame, local: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join in which local values win."""
    a, b = remote.withColumnRenamed(value, "_r"), local.withColumnRenamed(value, "_l")
    return a.join(b, keys, "full").select(*keys, F.coalesce("_l", "_r").alias(value))
