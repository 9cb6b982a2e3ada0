"""Aggregations, windows and joins over encounters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.encounters import floored, severity
from .graph import checkpoint


def endpoints(alerts: DataFrame, *keep: str) -> DataFrame:
    """One row per endpoint of an alert: sat and the kept columns."""
    return alerts.select(F.explode(F.array("sat1", "sat2")).alias("sat"), *keep)


def node_hit_probability(alerts: DataFrame) -> DataFrame:
    """sat, p_hit = 1 - prod(1 - pc) over its alerts, as a sum of logarithms."""
    return endpoints(alerts, "pc").groupBy("sat").agg(floored(-F.expm1(F.sum(F.log1p(-F.least("pc", F.lit(1 - 1e-15))))), 9).alias("p_hit"), F.count(F.lit(1)).alias("n_alerts"))


def exposure(alerts: DataFrame, event: Column, weight: Column) -> DataFrame:
    """Exposure per (event, sat): weighted probability, nearest approach and its time, band."""
    rows = endpoints(alerts.withColumn("event", event).withColumn("w", weight), "event", "w", "pc", "miss_km", "tca_h", "alert_id")
    out = rows.groupBy("event", "sat").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("fragments"), F.sum(F.col("w") * F.col("pc")).alias("s"), F.max("pc").alias("m"), F.min("miss_km").alias("min_miss_km"), F.min_by("tca_h", F.struct("miss_km", "alert_id")).alias("tca_of_min_h"), F.min("tca_h").alias("first_tca_h"))
    agg = 1 - F.exp(-F.col("s"))  # the SQL's form: places follow the ninth digit, where expm1 may round to the other side
    return out.select("event", "sat", "n", floored(F.col("fragments")).alias("fragments"), floored(agg, 9).alias("aggregate_pc"), floored(F.col("m"), 9).alias("max_pc"), "min_miss_km", "tca_of_min_h", "first_tca_h", severity(agg, F.col("min_miss_km")).alias("severity"))


def top_alerts(alerts: DataFrame, k: int) -> DataFrame:
    """The k likeliest alerts of each satellite."""
    w = Window.partitionBy("sat").orderBy(F.desc("pc9"), "miss_km", "alert_id")
    rows = endpoints(alerts.withColumn("pc9", floored(F.col("pc"), 9)), "alert_id", "pc9", "miss_km")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(physics: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Full outer join of two alert sources on the unordered pair; the first row of a pair, physics wins."""
    one = lambda df: df.withColumn("rn", F.row_number().over(Window.partitionBy("sat1", "sat2").orderBy("alert_id"))).where("rn = 1")
    p, e = one(physics).alias("p"), one(enrichment).alias("e")
    met = p.join(e, (F.col("p.sat1") == F.col("e.sat1")) & (F.col("p.sat2") == F.col("e.sat2")), "full_outer")
    both = lambda c: F.coalesce(f"p.{c}", f"e.{c}").alias(c)
    return met.select(both("sat1"), both("sat2"), both("alert_id"), both("miss_km"), F.when(F.col("p.sat1").isNull(), "graph").when(F.col("e.sat1").isNull(), "physics").otherwise("both").alias("origin"))


def worsened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs that a manoeuvre makes worse: new, likelier by a tenth, or nearer by a tenth."""
    best = lambda df, n: df.groupBy("sat1", "sat2").agg(F.max("pc").alias(f"pc_{n}"), F.min("miss_km").alias(f"miss_{n}"))
    out = best(after, "after").join(best(before, "before"), ["sat1", "sat2"], "left")
    is_new = F.col("pc_before").isNull()
    worse = is_new | (F.col("pc_after") > 1.1 * F.col("pc_before")) | (F.col("miss_after") < 0.9 * F.col("miss_before"))
    unsafe = worse & ((F.col("pc_after") >= 1e-6) | (F.col("miss_after") < 1))
    return out.where(worse).select("sat1", "sat2", is_new.alias("is_new"), floored(F.col("pc_after"), 9).alias("pc_after"), "miss_after", unsafe.alias("unsafe"))


VERDICTS = ("APPROVE", "MODIFY", "REJECT")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rn``, from 0, in the given order: a distributed sort, then offsets of its partitions."""
    rows = checkpoint(df.orderBy(*order).withColumn("rn", F.monotonically_increasing_id()))
    part = F.shiftright("rn", 33)
    sizes = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row per partition
    return rows.join(F.broadcast(before), part == F.col("p")).withColumn("rn", F.col("before") + F.col("rn").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "before")


def feedback_rounds(decisions: DataFrame, size: int = 10, last: int = 20) -> DataFrame:
    """Approval rate of each complete round of ``size`` known verdicts in the order of seq, the last rounds only."""
    known = numbered(decisions.where(F.col("verdict").isin(*VERDICTS)), "seq").withColumn("round", F.floor(F.col("rn") / size))
    rounds = known.groupBy("round").agg(F.count(F.lit(1)).alias("n"), floored(F.avg(F.when(F.col("verdict") != "REJECT", 1.0).otherwise(0.0))).alias("approval_rate"))
    return rounds.where(F.col("n") == size).drop("n").orderBy(F.desc("round")).limit(last)


#: Width of the time buckets that part the rows of one object (microseconds).
BUCKET_US = 86_400_000_000


def _bucketed(df: DataFrame, ts: str, width_us: int) -> DataFrame:
    return df.withColumn("__b", F.floor(F.unix_micros(ts) / width_us))


def _before(key: str) -> WindowSpec:
    """Earlier buckets of an object; their summaries are one row each."""
    return Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def rolling_score(telemetry: DataFrame, rows: int = 50, block: int = 50_000, width_us: int = BUCKET_US) -> DataFrame:
    """z-score of each value within the object's last ``rows`` values, itself included; 0 without spread, an anomaly from 3 on.

    An object's rows are numbered inside time buckets, from what the buckets before hold, and then dealt in
    blocks of numbers; the last rows of a block are copied to the next. So no task holds more than a bucket
    or a block of one object.
    """
    t = _bucketed(telemetry.select("event_id", "object_id", "ts", "value"), "ts", width_us)
    held = t.groupBy("object_id", "__b").agg(F.count(F.lit(1)).alias("n"))
    first = held.select("object_id", "__b", F.coalesce(F.sum("n").over(_before("object_id")), F.lit(0)).alias("__n"))
    mixed = t.withColumn("__n", F.lit(1).cast("long")).unionByName(first.withColumn("__carry", F.lit(True)), allowMissingColumns=True)
    at = Window.partitionBy("object_id", "__b").orderBy(F.desc_nulls_last("__carry"), "ts", "event_id")
    n = mixed.withColumn("__n", F.sum("__n").over(at)).where("__carry is null")
    own = F.floor(F.col("__n") / block)
    copies = n.withColumn("__own", own).withColumn("__k", F.explode(F.when(F.floor((F.col("__n") + rows - 1) / block) > own, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("object_id", "__k").orderBy("__n").rowsBetween(1 - rows, 0)
    out = copies.select("event_id", "object_id", "value", (F.col("__k") == F.col("__own")).alias("__mine"), F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"), F.count("value").over(w).alias("n"))
    flat = (F.col("n") < 2) | (F.col("s") < 1e-6)
    z = (F.col("value") - F.col("m")) / F.col("s")
    return out.where("__mine").select("event_id", "object_id", F.when(flat, 0.0).otherwise(floored(z)).alias("z"), (~flat & (z >= 3)).alias("anomalous"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, order: str, width_us: int = BUCKET_US) -> DataFrame:
    """Every left row with the latest right value at or before it: a union and a window over time buckets, no range join.

    The last value of the buckets before enters each bucket as its first row, so a busy key is not one task.
    """
    a = left.select(key, ts, F.col(order).alias("__o"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__v"))
    b = right.select(key, ts, F.col(order).alias("__o"), F.lit(0).alias("__side"), F.col(value).cast("double").alias("__v"))
    rows = _bucketed(a.unionByName(b), ts, width_us)
    known = F.when(F.col("__v").isNotNull(), F.struct(ts, "__o"))
    held = rows.groupBy(key, "__b").agg(F.max_by("__v", known).alias("__v"))
    carried = held.select(key, "__b", F.last("__v", ignorenulls=True).over(_before(key)).alias("__v")).withColumn("__side", F.lit(-1))
    w = Window.partitionBy(key, "__b").orderBy(F.expr("__side >= 0"), ts, "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    mixed = rows.unionByName(carried, allowMissingColumns=True)
    return mixed.withColumn("last_value", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(key, F.col("__o").alias(order), "last_value")


def sessions(events: DataFrame, gap_s: int = 3600, width_us: int = BUCKET_US) -> DataFrame:
    """object_id, session, n, seconds: runs of events with gaps up to gap_s.

    Gaps are found inside time buckets; the last time and the number of sessions of the buckets before
    enter each bucket as its first row.
    """
    t = _bucketed(events.select("object_id", "event_id", "ts"), "ts", width_us).withColumn("__t", F.unix_micros("ts"))
    w = Window.partitionBy("object_id", "__b").orderBy("__carry", "__t", "event_id")
    far = lambda gap: F.when(gap <= gap_s * 1_000_000, 0).otherwise(1)
    inner = F.col("__t") - F.lag("__t").over(Window.partitionBy("object_id", "__b").orderBy("__t", "event_id"))
    held = t.withColumn("__far", F.when(inner.isNotNull(), far(inner)).otherwise(0)).groupBy("object_id", "__b").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.sum("__far").alias("more"))
    one = Window.partitionBy("object_id").orderBy("__b")
    held = held.withColumn("__before", F.lag("last").over(one)).withColumn("more", F.col("more") + far(F.col("first") - F.col("__before")))
    carried = held.select("object_id", "__b", F.col("__before").alias("__t"), F.coalesce(F.sum("more").over(_before("object_id")), F.lit(0)).alias("__start"), F.lit(0).alias("__carry"))
    mixed = t.withColumn("__carry", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    new = F.coalesce(F.col("__start"), far(F.col("__t") - F.lag("__t").over(w)).cast("long"))
    rows = mixed.withColumn("new", new).withColumn("session", F.sum("new").over(w)).where("__carry = 1")
    return rows.groupBy("object_id", "session").agg(F.count(F.lit(1)).alias("n"), F.floor((F.max("__t") - F.min("__t")) / 1_000_000).alias("seconds"))


def followed_rate(rows: DataFrame, key: str, clock: str, shown: str, order: str) -> DataFrame:
    """key, order, rate: how fast ``shown`` runs against ``clock`` (milliseconds), smoothed by a fifth.

    A sample twice or half the rate is followed at once; gaps below 100 ms, backward and absurd samples
    change nothing. The fold depends on its order, so a key is one task's work, read in sorted batches with
    one number carried over; no group is held. A null key is an object of its own; a null clock changes nothing.
    """
    schema = f"{key} long, {order} long, rate double"

    def fold(batches):
        last, clock0, shown0, rate = object(), None, 0, 1.0
        for batch in batches:
            out = []
            for k, at, c, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != last:
                    last, rate, clock0 = k, 1.0, None
                if c is None or s is None:
                    out.append((k, at, rate))
                    continue
                if clock0 is not None and c - clock0 >= 100:
                    sample = (s - shown0) / (c - clock0)
                    if 0 < sample <= 100000:
                        rate = sample if sample > rate * 2 or sample < rate / 2 else rate + (sample - rate) * 0.2
                clock0, shown0 = c, s
                out.append((k, at, rate))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[key, order, "rate"])

    narrow = rows.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(clock).cast("long").alias(clock), F.col(shown).cast("long").alias(shown))
    return narrow.repartition(key).sortWithinPartitions(key, clock, order).mapInArrow(fold, schema)
