"""Queries of ranks, correlations, quantiles, metrics, sampling, histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.encounters import floored
from ..operators import statistics as S
from ..operators.encounters import endpoints, exposure, numbered
from ..operators.ordered import arc_spans as arc_span_of
from ..operators.ordered import placed, with_neighbours
from ..sources.derived import ALERTS_SQL, alerts, table
from .catalog import ENDS_SQL, R6, R9, query, telemetry

HOLES = {"miss": "CASE WHEN alert_id % 10 < 7 THEN miss_km END", "speed": "CASE WHEN alert_id % 7 < 5 THEN v_rel END", "age": "age_h", "sigma": "CASE WHEN alert_id % 3 < 2 THEN sigma_km END"}
part = ", ".join(f"{e} AS {n}" for n, e in HOLES.items())


def holes(spark, sf_dir):
    return alerts(spark, sf_dir).selectExpr("alert_id", *[f"{e} AS {n}" for n, e in HOLES.items()])


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(HOLES) for b in list(HOLES)[i + 1 :])


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT {part} FROM alerts), p AS ({_PAIRS}), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p)
SELECT a, b, count(*) AS n, floor(corr(x, y) * 1e4 + 0.5) / 1e4 AS pearson, floor(corr(rx, ry) * 1e4 + 0.5) / 1e4 AS spearman FROM r GROUP BY a, b""")
def correlation_pairs(spark, sf_dir):
    """Pearson and Spearman of every pair of features, pairwise deletion, ties at mean ranks."""
    return S.pair_correlations(holes(spark, sf_dir), list(HOLES))


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT {part} FROM alerts), p AS ({_PAIRS}), c AS (SELECT a, b, floor(corr(x, y) * 1e4 + 0.5) / 1e4 AS r FROM p GROUP BY a, b) SELECT a, b, r AS pearson FROM c ORDER BY abs(r) DESC, a, b LIMIT 5""")
def strongest_pairs(spark, sf_dir):
    return S.pair_correlations(holes(spark, sf_dir), list(HOLES)).orderBy(F.desc(F.abs("pearson")), "a", "b").limit(5).select("a", "b", "pearson")


@query(f"WITH {ALERTS_SQL}, v AS (SELECT DISTINCT miss_km, age_h FROM alerts), t AS (SELECT age_h, miss_km, count(*) AS n FROM alerts GROUP BY 1, 2) SELECT age_h, miss_km, sum(n) OVER (PARTITION BY age_h ORDER BY miss_km) - (n - 1) / 2.0 AS rank FROM t")
def tie_ranks(spark, sf_dir):
    """Mean ranks of the misses within each age."""
    return S.average_ranks(alerts(spark, sf_dir), ["age_h"], "miss_km")


@query(f"WITH {ALERTS_SQL} SELECT alert_id % 50 AS event, count(*) AS n, {R6.format('quantile_cont(miss_km, 0.5)')} AS median_km, {R6.format('quantile_cont(miss_km, 0.9)')} AS p90_km, {R6.format('quantile_cont(miss_km, 0.25)')} AS q1_km FROM alerts GROUP BY 1")
def miss_quantiles(spark, sf_dir):
    """Exact quantiles of every event's misses by two passes over a histogram."""
    q = S.histogram_quantiles(alerts(spark, sf_dir).select((F.col("alert_id") % 50).alias("event"), "miss_km"), ["event"], "miss_km", [0.5, 0.9, 0.25])
    return q.select("event", "n", *[floored(F.col(c)).alias(n) for c, n in (("q0", "median_km"), ("q1", "p90_km"), ("q2", "q1_km"))])


STRATA = "SELECT 'p' || alert_id % 2 || '-' || CAST(floor(miss_km / 4) AS BIGINT) AS stratum, alert_id, v_rel, miss_km FROM (SELECT DISTINCT alert_id, v_rel, miss_km FROM alerts)"
SEATS_SQL = f"""strata AS ({STRATA}), sizes AS (SELECT stratum, count(*) AS size FROM strata GROUP BY 1), quotas AS (SELECT *, greatest(1.0, 300.0 * size / sum(size) OVER ()) AS q FROM sizes), based AS (SELECT *, least(floor(q), size) AS base FROM quotas), ranked AS (SELECT *, row_number() OVER (ORDER BY base >= size, -(q - floor(q)), stratum) AS rn, 300 - sum(base) OVER () AS remaining FROM based),
seats AS (SELECT stratum, size, CAST(base + CASE WHEN rn <= remaining AND base < size THEN 1 ELSE 0 END AS BIGINT) AS seats FROM ranked)"""


def strata(spark, sf_dir):
    a = alerts(spark, sf_dir).select("alert_id", "v_rel", "miss_km").distinct()
    return a.select(F.concat(F.lit("p"), (F.col("alert_id") % 2).cast("string"), F.lit("-"), F.floor(F.col("miss_km") / 4).cast("string")).alias("stratum"), "alert_id", "v_rel", "miss_km")


@query(f"WITH {ALERTS_SQL}, {SEATS_SQL} SELECT * FROM seats")
def largest_remainder(spark, sf_dir):
    """Display seats of every stratum."""
    return S.largest_remainder(strata(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), 300)


@query(f"""WITH {ALERTS_SQL}, {SEATS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY v_rel, alert_id, miss_km) - 1 AS rn FROM strata), want AS (SELECT DISTINCT stratum, CASE WHEN seats = 1 THEN 0 ELSE CAST(floor(i * (size - 1) / (seats - 1) + 0.5) AS BIGINT) END AS rn FROM (SELECT *, unnest(range(0, seats)) AS i FROM seats WHERE seats > 0))
SELECT stratum, alert_id, v_rel, miss_km FROM n JOIN want USING (stratum, rn)""")
def stratified_sample(spark, sf_dir):
    """A deterministic display sample: evenly spaced ranks of speed in every stratum (sampling is the feature)."""
    rows = strata(spark, sf_dir)
    seats = S.largest_remainder(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), 300)
    return S.evenly_spaced(rows, seats, ["v_rel", "alert_id", "miss_km"])


@query("""WITH t AS (SELECT event_id, user_id AS object_id, value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT count(*) AS n, floor(avg(abs(value - a)) * 1e6 + 0.5) / 1e6 AS persistence_mae, floor(avg(abs(value - (2 * a - b))) * 1e6 + 0.5) / 1e6 AS linear_mae, floor(sqrt(avg((value - a) * (value - a))) * 1e6 + 0.5) / 1e6 AS persistence_rmse, floor(avg(CASE WHEN value > 50 THEN abs(value - a) END) * 1e6 + 0.5) / 1e6 AS high_mae FROM t WHERE b IS NOT NULL""")
def baseline_errors(spark, sf_dir):
    """Errors of the last value and of the line through the last two as forecasts; conditional and squared ones too."""
    before = lambda w: {"a": F.lag("value").over(w), "b": F.lag("value", 2).over(w)}
    t = with_neighbours(telemetry(spark, sf_dir).select("object_id", "ts", "event_id", "value"), ["object_id"], ["ts", "event_id"], before, 2).where("b is not null")
    off, lin = F.abs(F.col("value") - F.col("a")), F.abs(F.col("value") - (2 * F.col("a") - F.col("b")))
    return t.agg(F.count(F.lit(1)).alias("n"), floored(F.avg(off)).alias("persistence_mae"), floored(F.avg(lin)).alias("linear_mae"), floored(F.sqrt(F.avg(off * off))).alias("persistence_rmse"), floored(F.avg(F.when(F.col("value") > 50, off))).alias("high_mae"))


@query("""WITH w AS (SELECT event_id, user_id AS object_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS held FROM events)
SELECT event_id, object_id, held, list_aggregate(list_concat(list_transform(range(0, 8 - len(l)), lambda i: l[1]), l), 'sum') AS window_sum, l[1] AS oldest FROM w""")
def ring_history(spark, sf_dir):
    """Each object's last eight values, padded on the left with the oldest, and how many of 120 are held."""
    last = lambda w: {"l": F.collect_list("value").over(w.rowsBetween(-7, 0)), "held": F.count(F.lit(1)).over(w.rowsBetween(-119, 0))}
    h = with_neighbours(telemetry(spark, sf_dir).select("event_id", "object_id", "ts", "value"), ["object_id"], ["ts", "event_id"], last, 119)
    padded = F.concat(F.array_repeat(F.col("l")[0], F.lit(8) - F.size("l")), F.col("l"))
    return h.select("event_id", "object_id", "held", F.aggregate(padded, F.lit(0.0), lambda a, x: a + x).alias("window_sum"), F.col("l")[0].alias("oldest"))


@query("SELECT count(*) AS records, count(DISTINCT user_id) AS objects, floor(max(n) * 1.0) AS longest FROM events, (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY user_id))")
def buffer_stats(spark, sf_dir):
    by = telemetry(spark, sf_dir).groupBy("object_id").agg(F.count(F.lit(1)).alias("c"))
    return by.agg(F.sum("c").alias("records"), F.count(F.lit(1)).alias("objects"), F.max("c").cast("double").alias("longest"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS predictions, count(*) FILTER (value > 50) AS high, max(value) AS largest FROM events GROUP BY 1")
def daily_counters(spark, sf_dir):
    """Counters that start again with every UTC day."""
    return telemetry(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("value") > 50).alias("high"), F.max("value").alias("largest"))


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT {part} FROM alerts), m AS (SELECT unnest(['miss', 'speed', 'age', 'sigma']) AS input, unnest([miss IS NULL, speed IS NULL, age IS NULL, sigma IS NULL]) AS gone FROM t) SELECT input, count(*) FILTER (gone) AS missing, floor(avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS share FROM m GROUP BY input""")
def missing_inputs(spark, sf_dir):
    """How often each input of the surrogate is missing."""
    gone = F.explode(F.array(*[F.struct(F.lit(n).alias("input"), F.col(n).isNull().alias("gone")) for n in HOLES]))
    return holes(spark, sf_dir).select(gone.alias("x")).groupBy("x.input").agg(F.count_if("x.gone").alias("missing"), floored(F.avg(F.when(F.col("x.gone"), 1.0).otherwise(0.0))).alias("share"))


@query(f"""WITH {ALERTS_SQL}, m AS (SELECT quantile_cont(miss_km, 0.5) FILTER (alert_id % 10 < 7) AS mm, quantile_cont(v_rel, 0.5) FILTER (alert_id % 7 < 5) AS ms, quantile_cont(sigma_km, 0.5) FILTER (alert_id % 3 < 2) AS mg FROM alerts),
f AS (SELECT CASE WHEN alert_id % 10 < 7 THEN miss_km ELSE mm END AS miss, CASE WHEN alert_id % 7 < 5 THEN v_rel ELSE ms END AS speed, age_h AS age, CASE WHEN alert_id % 3 < 2 THEN sigma_km ELSE mg END AS sigma FROM alerts, m)
SELECT {", ".join(f"floor(corr({a}, {b}) * 1e6 + 0.5) / 1e6 AS {a}_{b}" for i, a in enumerate(HOLES) for b in list(HOLES)[i + 1 :])} FROM f""")
def imputed_gram(spark, sf_dir):
    """Correlation matrix after median imputation and standardising: what the principal axes are taken from."""
    return gram(spark, sf_dir)


def gram(spark, sf_dir):
    h = holes(spark, sf_dir)
    long = h.select(F.explode(F.array(*[F.struct(F.lit(n).alias("input"), F.col(n).cast("double").alias("v")) for n in HOLES])).alias("x")).select("x.*").where("v is not null")
    mid = F.broadcast(S.histogram_quantiles(long, ["input"], "v", [0.5]).groupBy().pivot("input", list(HOLES)).agg(F.first("q0")).select(*[F.col(n).alias(f"m_{n}") for n in HOLES]))  # one row
    f = h.crossJoin(mid).select(*[F.coalesce(n, f"m_{n}").alias(n) for n in HOLES])
    names = list(HOLES)
    return f.agg(*[floored(F.corr(a, b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]])


@query()
def principal_axes(spark, sf_dir):
    """component, share and loadings of the standardised, median-imputed features; each axis' largest loading is positive.

    The Gramian is a distributed one-row aggregate; its four by four eigenproblem is solved on the driver
    and tested against numpy on the whole matrix.
    """
    import numpy as np

    names, row = list(HOLES), gram(spark, sf_dir).first().asDict()
    c = np.eye(len(names))
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            c[i, j] = c[j, i] = row[f"{a}_{names[j]}"]
    values, axes = np.linalg.eigh(c)
    out = []
    for k, at in enumerate(np.argsort(-values)):
        axis = axes[:, at] * np.sign(axes[np.argmax(np.abs(axes[:, at])), at])
        out.append((k + 1, round(float(values[at] / values.sum()), 6), *[round(float(x), 6) for x in axis]))
    return spark.createDataFrame(out, "component int, share double, " + ", ".join(f"{n} double" for n in names))


@query(f"""WITH {ALERTS_SQL}, {ENDS_SQL}, t AS (SELECT sat, count(*) AS degree, avg(pc) AS mean_pc, max(pc) AS max_pc, avg(miss_km) AS mean_miss, min(miss_km) AS min_miss, avg(v_rel) AS mean_speed, avg(tca_h) AS mean_tca FROM ends GROUP BY sat)
SELECT sat, degree, {R6.format('mean_pc')} AS mean_pc, {R6.format('max_pc')} AS max_pc, {R6.format('mean_miss')} AS mean_miss, min_miss, {R6.format('mean_speed')} AS mean_speed, {R6.format('mean_tca')} AS mean_tca, {R6.format('degree * mean_pc')} AS influence FROM t""")
def graph_features(spark, sf_dir):
    """Summary features of every node over its incident alerts."""
    e = endpoints(alerts(spark, sf_dir), "pc", "miss_km", "v_rel", "tca_h").groupBy("sat").agg(F.count(F.lit(1)).alias("degree"), F.avg("pc").alias("p"), F.max("pc").alias("mp"), F.avg("miss_km").alias("m"), F.min("miss_km").alias("min_miss"), F.avg("v_rel").alias("v"), F.avg("tca_h").alias("t"))
    f = lambda c, n: floored(F.col(c)).alias(n)
    return e.select("sat", "degree", f("p", "mean_pc"), f("mp", "max_pc"), f("m", "mean_miss"), "min_miss", f("v", "mean_speed"), f("t", "mean_tca"), floored(F.col("degree") * F.col("p")).alias("influence"))


@query("""WITH a AS (SELECT c_nationkey AS g, (c_custkey * 37 % 3600) / 10.0 AS angle FROM customer), d AS (SELECT g, angle, coalesce(lead(angle) OVER w, min(angle) OVER (PARTITION BY g) + 360) - angle AS gap FROM a WINDOW w AS (PARTITION BY g ORDER BY angle)) SELECT g, CAST(floor((360 - max(gap)) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS span_deg, CAST(arg_max(angle, (gap, -angle)) AS DOUBLE) AS last_deg FROM d GROUP BY g""")
def arc_spans(spark, sf_dir):
    """The arc that covers all angles of a group: 360 degrees less the largest gap."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") * 37 % 3600 / 10.0).alias("angle"))
    return arc_span_of(a, "g", "angle").withColumn("span_deg", floored(F.col("span_deg")))


@query("""WITH n AS (SELECT event_id, user_id AS object_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, object_id FROM n WHERE (rn - 1) % CAST(ceil(n / 30.0) AS BIGINT) = 0""")
def strided_track(spark, sf_dir):
    """Every object's track thinned by a stride to at most thirty points (thinning is the feature)."""
    n = placed(telemetry(spark, sf_dir).select("event_id", "object_id", "ts"), ["object_id"], ["ts", "event_id"])
    return n.where(F.col("place") % F.ceil(F.col("of") / 30.0) == 0).select("event_id", "object_id")


@query("""WITH t AS (SELECT event_id, user_id AS object_id, ts, epoch_us(ts) AS us, value FROM events), b AS (SELECT *, lag(us) OVER w AS u0, lag(value) OVER w AS v0 FROM t WINDOW w AS (PARTITION BY object_id ORDER BY us, event_id))
SELECT event_id, object_id, floor((v0 + (value - v0) * 0.25) * 1e6 + 0.5) / 1e6 AS quarter_value, CAST(floor(u0 + (us - u0) * 0.25) AS BIGINT) AS quarter_us FROM b WHERE us > u0""")
def interpolated_track(spark, sf_dir):
    """Values a quarter of the way between neighbouring samples, on the line between them."""
    before = lambda w: {"u0": F.lag("us").over(w), "v0": F.lag("value").over(w)}
    rows = telemetry(spark, sf_dir).select("event_id", "object_id", F.unix_micros("ts").alias("us"), "value")
    t = with_neighbours(rows, ["object_id"], ["us", "event_id"], before, 1).where("us > u0")
    return t.select("event_id", "object_id", floored(F.col("v0") + (F.col("value") - F.col("v0")) * 0.25).alias("quarter_value"), F.floor(F.col("u0") + (F.col("us") - F.col("u0")) * 0.25).alias("quarter_us"))


@query("""WITH n AS (SELECT user_id AS object_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 2 = 0), f AS (SELECT user_id AS object_id, arg_max(value, (ts, event_id)) AS actual FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT object_id, rn, floor(abs(value - actual) * 1e6 + 0.5) / 1e6 AS residual FROM n JOIN f USING (object_id) WHERE rn <= 3""")
def settled_residuals(spark, sf_dir):
    """The latest three due predictions of each object with their residual against the last actual value."""
    t = telemetry(spark, sf_dir)
    w = Window.partitionBy("object_id").orderBy(F.desc("ts"), F.desc("event_id"))
    due = t.where("event_id % 2 = 0").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    actual = t.where("event_id % 2 = 1").groupBy("object_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("actual"))
    return due.join(actual, "object_id").select("object_id", "rn", floored(F.abs(F.col("value") - F.col("actual"))).alias("residual"))


@query(f"WITH {ALERTS_SQL} SELECT alert_id, {R9.format('pc')} AS pc9, row_number() OVER (ORDER BY {R9.format('pc')}, miss_km, alert_id) AS rank FROM (SELECT DISTINCT alert_id, pc, miss_km FROM alerts)")
def ordinal_ranks(spark, sf_dir):
    """Place of every alert by probability, ties in the order of miss and id: a distributed sort with the offsets of its partitions."""
    a = alerts(spark, sf_dir).select("alert_id", floored(F.col("pc"), 9).alias("pc9"), "miss_km").distinct()
    return numbered(a, "pc9", "miss_km", "alert_id").select("alert_id", "pc9", (F.col("rn") + 1).alias("rank"))


@query(f"""WITH {ALERTS_SQL}, ends AS (SELECT sat1 AS sat, * FROM alerts UNION ALL SELECT sat2 AS sat, * FROM alerts), e AS (SELECT alert_id % 7 AS event, sat, {R9.format('1 - exp(-sum((1 + alert_id % 4) * pc))')} AS aggregate_pc FROM ends GROUP BY 1, 2)
SELECT event, sat, aggregate_pc, row_number() OVER (PARTITION BY event ORDER BY aggregate_pc DESC, sat) AS place FROM e""")
def exposure_order(spark, sf_dir):
    """Exposed satellites of every event, the most exposed first: one distributed sort, places counted from each event's first."""
    e = exposure(alerts(spark, sf_dir), F.col("alert_id") % 7, (1 + F.col("alert_id") % 4).cast("double")).select("event", "sat", "aggregate_pc")
    ranked = placed(e.withColumn("down", -F.col("aggregate_pc")), ["event"], ["down", "sat"])
    return ranked.select("event", "sat", "aggregate_pc", (F.col("place") + 1).alias("place"))
