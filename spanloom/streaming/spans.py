"""Streaming twins of the span operators, on event time with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: events closer than ``gap``."""
    e = events.withWatermark(ts, late)
    return e.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("st"), F.col("s.end").alias("en"), "n")


def tumbling_levels(events: DataFrame, key: str, ts: str, value: str, width: str, late: str) -> DataFrame:
    e = events.withWatermark(ts, late)
    return e.groupBy(key, F.window(ts, width).alias("w")).agg(F.avg(value).alias("level"), F.count("*").alias("n")).select(key, F.col("w.start").alias("st"), "level", "n")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Events whose keys weren't seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def debounced(events: DataFrame, key: str, ts: str, least_s: float, late: str) -> DataFrame:
    """Events more than ``least_s`` after the last kept one of their key, in order of their time: events wait until the watermark has passed them, so
    results don't depend on how they come in. The state is the waiting times and the last kept one, and goes when none waits and
    ``least_s`` has passed."""
    kind = events.schema[key].dataType.simpleString()

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (float("-inf"), [])
        waiting = sorted([*waiting, *(x for b in batches for x in b["t"])])
        now = state.getCurrentWatermarkMs() / 1000
        out = []
        while waiting and waiting[0] <= now:
            t = waiting.pop(0)
            if t - last > least_s:
                last = t
                out.append(t)
        if waiting or now < last + least_s:
            state.update((last, waiting))
            state.setTimeoutTimestamp(int(max(1000 * (waiting[0] if waiting else last + least_s), 1000 * now)) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(out), "t": out})

    e = events.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts)).cast("double") / 1e6).alias("t"))
    return e.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, t double", "last double, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def anchored(events: DataFrame, key: str, ts: str, width_s: float, late: str) -> DataFrame:
    """Windows that open with a key's first event more than ``width_s`` after the start of the one before: key and start."""
    return debounced(events, key, ts, width_s, late).withColumnRenamed("t", "st")


def upserting(path: str, keys: list[str]):
    """A foreachBatch function that merges each batch, once, into the versioned table at path."""

    def merge(batch: DataFrame, number: int) -> None:
        from spanloom.sources.sinks import upsert

        upsert(batch.sparkSession, batch, path, keys, dry_run=False, batch=number)  # a batch that comes again changes nothing

    return merge
