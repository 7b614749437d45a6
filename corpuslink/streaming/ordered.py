"""Streams whose results don't depend on when rows arrive: quotas in event time, first arrivals, and counts of what came too late.

A watermark says how long a row may be late. Rows are held until it has passed them and then taken in event-time order, so a stream that is
delayed, paused or replayed gives the rows of its batch twin. Rows later than that are dropped by Spark, which tells them by the watermark of
the batch before (by that of their own batch where ``spark.sql.streaming.statefulOperator.allowMultiple`` is false); ``late_rows`` counts them. A row
that comes behind the watermark but isn't dropped is taken at once, after what was taken before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import first_per_key
from .counters import timed


def anchored_quota_in_time(events: DataFrame, key: str, order: str, quota: int, seconds: float = 60.0, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Per event: key, order, ok, as ``counters.anchored_quota`` gives them for the whole table; events without a time are left out.

    State a key: its count, its window's end, and the events that the watermark hasn't passed, which are as many as come within ``late``. An
    event-time timer wakes a key when its first held event is due, and after its window's end to forget it: whatever comes
    then opens a new window in any case.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, reset, ats, ids = state.get if state.exists else (0, float("-inf"), [], [])
        held = list(zip(map(float, ats), ids, strict=True))
        for pdf in batches:
            held.extend(zip(pdf["at"], pdf[order], strict=True))
        held.sort()
        mark = state.getCurrentWatermarkMs()
        due = bisect_right(held, mark / 1000, key=lambda x: x[0])
        ok = []
        for at, _ in held[:due]:
            if at >= reset:
                count, reset = 0, at + seconds
            ok.append(count < quota)
            count += 1
        done, held = held[:due], held[due:]
        if held or reset * 1000 > mark:
            state.update((count, reset, [x[0] for x in held], [x[1] for x in held]))
            state.setTimeoutTimestamp(max(mark + 1, int(1000 * (held[0][0] if held else reset)) + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * due, order: [x[1] for x in done], "ok": ok})

    rows = timed(events, ts).filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, order, ts, (F.unix_micros(ts).cast("double") / 1e6).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {order} {kinds[order]}, ok boolean", f"n long, reset double, ats array<double>, ids array<{kinds[order]}>", "append", GroupStateTimeout.EventTimeTimeout
    )


def first_arrivals(items: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row of each key among those that arrive within ``late`` of each other; state is dropped behind the watermark."""
    return timed(items, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counted(items: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """``items`` with observed metrics under ``name``: rows that arrived, those without a time, and the first and last time."""
    time = F.col(ts).cast("timestamp")
    return items.observe(name, F.count("*").alias("arrived"), F.count(F.when(time.isNull(), 1)).alias("untimed"), F.min(time).alias("first"), F.max(time).alias("last"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the progress that the query still holds."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def arrived(query: StreamingQuery, name: str, metric: str = "arrived") -> int:
    """Sum of an observed metric over the progress that the query still holds."""
    return sum(int(p.observedMetrics[name][metric] or 0) for p in query.recentProgress if name in p.observedMetrics)


def appending_sink(path: str, keys: list[str], order: list, made: Callable[[DataFrame], DataFrame] | None = None):
    """For ``foreachBatch``: appends the first row of each key that the table lacks, after ``made`` (such as a link's check) has seen these rows alone.

    Each batch has a folder of its own and looks at the folders before it, of which only the keys are read; a batch that comes again
    writes its folder anew, with the same rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []
        before = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < epoch]
        new = first_per_key(batch, keys, order)
        if before:
            new = new.join(spark.read.parquet(*before).select(*keys), keys, "left_anti")
        (made(new) if made else new).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write
