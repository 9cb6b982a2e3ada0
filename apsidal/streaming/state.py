"""Streams with state of their own: histories by object, late settlement, replacement by source, late rows, sessions.

Every operator gives the same final result for any cut of its input into batches, as its state does not
depend on the order in which rows of one object arrive. State is kept by key and bounded: by a number of
rows, by a watermark, or by what a source holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY_KIND = "object_id long, n long, last_us long, mean double, recent array<double>"


def histories(stream: DataFrame, keep: int = 120, recent: int = 8, expiry_ms: int | None = None, late: str = "2 days") -> DataFrame:
    """object_id, n, last_us, mean, recent: the last ``keep`` rows of each object by (ts, event_id), as a running summary.

    Reads object_id, event_id, ts, value; emits in update mode, one row an object and batch. ``recent`` are
    the last values, padded with zeros on the left. A row that was seen already changes nothing. With
    ``expiry_ms`` an object is forgotten once the watermark (``late`` behind the newest row) has passed its
    last row by so much; rows behind the watermark are dropped then.
    """
    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.EventTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {(int(t), int(i)): v for t, i, v in zip(*state.get, strict=True)} if state.exists else {}
        for b in batches:
            held.update({(int(t), int(i)): float(v) for t, i, v in zip(b["us"], b["event_id"], b["value"], strict=True)})
            if len(held) > 2 * keep:
                held = dict(sorted(held.items())[-keep:])
        rows = sorted(held.items())[-keep:]
        state.update(([t for (t, _), _ in rows], [i for (_, i), _ in rows], [v for _, v in rows]))
        if expiry_ms is not None:
            state.setTimeoutTimestamp(max(rows[-1][0][0] // 1000 + expiry_ms, state.getCurrentWatermarkMs() + 1))
        values = [v for _, v in rows]
        yield pd.DataFrame({"object_id": [key[0]], "n": [len(rows)], "last_us": [rows[-1][0][0]], "mean": [sum(values) / len(values)], "recent": [([0.0] * recent + values)[-recent:]]})

    rows = stream if expiry_ms is None else stream.withWatermark("ts", late)
    rows = rows.where("object_id is not null and ts is not null and event_id is not null and value is not null")
    rows = rows.select("object_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "value")
    return rows.groupBy("object_id").applyInPandasWithState(step, HISTORY_KIND, "us array<long>, ids array<long>, vals array<double>", "update", timeout)


def settlements(predictions: DataFrame, actuals: DataFrame, within: str = "12 hours", late: str = "2 days") -> DataFrame:
    """prediction_id, object_id, due, predicted, actual_ts, actual: each prediction with the actuals from its due time on.

    Reads prediction_id, object_id, due, predicted and object_id, ts, actual. An interval join of two
    watermarked streams: a prediction waits until the watermark passes the end of its interval, then it is
    emitted with nulls if nothing met it; actuals are kept only as long as a prediction may ask for them.
    ``earliest`` picks the settling one.
    """
    p = predictions.withWatermark("due", late).withColumnRenamed("object_id", "p_object")
    a = actuals.withWatermark("ts", late).withColumnRenamed("object_id", "a_object")
    met = p.join(a, F.expr(f"p_object = a_object AND ts >= due AND ts <= due + INTERVAL {within}"), "leftOuter")
    return met.select("prediction_id", F.col("p_object").alias("object_id"), "due", "predicted", F.col("ts").alias("actual_ts"), "actual")


def earliest(settled: DataFrame) -> DataFrame:
    """One row a prediction: the residual to its earliest actual, null where none came in time."""
    first = F.min_by("actual", F.struct("actual_ts", "actual")).alias("actual")
    return settled.groupBy("prediction_id", "object_id").agg(F.first("predicted").alias("predicted"), first).select("prediction_id", "object_id", (F.col("predicted") - F.col("actual")).alias("residual"))


REPLACED_KIND = "source string, version long, n long, items array<string>"


def replaced_by_source(stream: DataFrame) -> DataFrame:
    """source, version, n, items: what each source holds after the newest frame that names it, in update mode.

    Reads source, version, item; a row with a null item names its source without giving it anything, so a
    frame of only such a row clears it. Older versions, and rows that were seen already, change nothing: a
    frame may be replayed, split over batches or arrive late. A source that no frame names keeps what it has.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, items = (state.get[0], set(state.get[1])) if state.exists else (None, set())
        for b in batches:
            newest = int(b["version"].max())
            if version is None or newest > version:
                version, items = newest, set()
            items |= {x for x in b["item"][b["version"] == version] if x is not None and x == x}
        state.update((version, sorted(items)))
        yield pd.DataFrame({"source": [key[0]], "version": [version], "n": [len(items)], "items": [sorted(items)]})

    rows = stream.where("source is not null and version is not null").select("source", "version", "item")
    return rows.groupBy("source").applyInPandasWithState(step, REPLACED_KIND, "version long, items array<string>", "update", GroupStateTimeout.NoTimeout)


LATE_KIND = "object_id long, event_id long, ts timestamp, late boolean"


def marked_late(stream: DataFrame, delay: str) -> DataFrame:
    """object_id, event_id, ts, late: every row, marked if the watermark had passed it when its batch began.

    Windowed aggregates drop such rows silently; here they come out beside the others, so that they can be
    counted or kept. The watermark is the newest time of earlier batches less ``delay``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        behind = state.getCurrentWatermarkMs() * 1000
        for b in batches:
            yield pd.DataFrame({"object_id": key[0], "event_id": b["event_id"], "ts": b["ts"], "late": b["us"] < behind})

    rows = stream.withWatermark("ts", delay).where("object_id is not null").select("object_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("object_id").applyInPandasWithState(step, LATE_KIND, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def closed_sessions(stream: DataFrame, gap: str = "8 hours", late: str = "2 days") -> DataFrame:
    """object_id, opened_us, expires_us, n of sessions that no row can reach any more: merging windows (a row at the very expiry goes on), emitted once the watermark passes them."""
    s = stream.withWatermark("ts", late).groupBy("object_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("object_id", F.unix_micros("session_window.start").alias("opened_us"), F.unix_micros("session_window.end").alias("expires_us"), "n")
