"""Queries of streams with state, each drained over the event table and held against its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encounters import floored
from ..streaming import state
from ..streaming.telemetry import drained, telemetry_stream
from .catalog import R6, R9, query


def events(spark, sf_dir):
    return telemetry_stream(spark, sf_dir).withColumnRenamed("user_id", "object_id")


@query(f"""WITH r AS (SELECT user_id AS object_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)
SELECT object_id, count(*) AS n, max(us) AS last_us, {R9.format('avg(value)')} AS mean, {R6.format('sum(value) FILTER (rn <= 8)')} AS recent_sum, {R6.format('coalesce(max(value) FILTER (rn = 8), 0)')} AS eighth FROM r WHERE rn <= 120 GROUP BY object_id""")
def stream_histories(spark, sf_dir):
    """The last 120 rows of every object, kept as a stream's state; the last eight values padded on the left."""
    h = drained(state.histories(events(spark, sf_dir)), "update", ["object_id"])
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    return h.select("object_id", "n", "last_us", floored(F.col("mean"), 9).alias("mean"), floored(total).alias("recent_sum"), floored(F.get("recent", F.lit(0))).alias("eighth"))


@query(f"""WITH p AS (SELECT event_id AS prediction_id, user_id AS object_id, ts + INTERVAL 6 HOURS AS due, value AS predicted FROM events WHERE event_id % 2 = 0), a AS (SELECT user_id AS object_id, ts, value AS actual FROM events WHERE event_id % 2 = 1),
w AS (SELECT least((SELECT max(due) FROM p), (SELECT max(ts) FROM a)) - INTERVAL 2 DAYS AS mark), m AS (SELECT p.*, a.ts, a.actual FROM p LEFT JOIN a ON a.object_id = p.object_id AND a.ts >= p.due AND a.ts <= p.due + INTERVAL 12 HOURS)
SELECT prediction_id, object_id, {R6.format('predicted - arg_min(actual, (ts, actual)) FILTER (ts IS NOT NULL)')} AS residual FROM m, w WHERE ts IS NOT NULL OR due + INTERVAL 12 HOURS < date_trunc('milliseconds', mark) GROUP BY prediction_id, object_id, predicted""")
def stream_settlements(spark, sf_dir):
    """Predictions for six hours ahead, settled by the earliest actual of the next twelve hours, or given up."""
    e = events(spark, sf_dir)
    p = e.where("event_id % 2 = 0").select(F.col("event_id").alias("prediction_id"), "object_id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("due"), F.col("value").alias("predicted"))
    a = events(spark, sf_dir).where("event_id % 2 = 1").select("object_id", "ts", F.col("value").alias("actual"))
    settled = state.earliest(drained(state.settlements(p, a), "append"))
    return settled.select("prediction_id", "object_id", floored(F.col("residual")).alias("residual"))


_FRAME = {"source": "event_type", "version": "unix_micros(ts) DIV 864000000000", "item": "CASE WHEN unix_micros(ts) DIV 864000000000 % 3 = 0 AND event_type LIKE '%e%' THEN NULL ELSE 'o' || object_id END"}


@query("""WITH f AS (SELECT event_type AS source, epoch_us(ts) // 864000000000 AS version, CASE WHEN epoch_us(ts) // 864000000000 % 3 = 0 AND event_type LIKE '%e%' THEN NULL ELSE 'o' || user_id END AS item FROM events), l AS (SELECT source, max(version) AS version FROM f GROUP BY source)
SELECT l.source, l.version, count(DISTINCT item) AS n, coalesce(min(item), '') AS first_item FROM l JOIN f ON f.source = l.source AND f.version = l.version GROUP BY 1, 2""")
def stream_replacement(spark, sf_dir):
    """What each source holds: its newest frame (ten days) replaces the one before, and a frame without items clears it."""
    frames = events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _FRAME.items()])
    held = drained(state.replaced_by_source(frames), "update", ["source"])
    return held.select("source", "version", "n", F.coalesce(F.get("items", F.lit(0)), F.lit("")).alias("first_item"))


@query("SELECT user_id AS object_id, count(*) AS n, 0 AS late FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def stream_late_rows(spark, sf_dir):
    """Rows of every object, and how many came behind the watermark (none when the table is read as one batch)."""
    rows = drained(state.marked_late(events(spark, sf_dir), "1 hour"), "append")
    return rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").cast("int").alias("late"))


@query("""WITH g AS (SELECT user_id AS object_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 28800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT object_id, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts)) + 28800000000 AS expires_us, count(*) AS n FROM s GROUP BY object_id, k) SELECT * FROM c WHERE expires_us <= (SELECT (epoch_us(max(ts)) - 172800000000) // 1000 * 1000 FROM events)""")
def stream_closed_sessions(spark, sf_dir):
    """Sessions of contact as a stream, emitted when the watermark has passed their expiry."""
    return drained(state.closed_sessions(events(spark, sf_dir)), "append")
