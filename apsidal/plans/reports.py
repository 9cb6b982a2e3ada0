"""Lookups, counters and lists around alerts: pair approaches, feedback, shells, contributions, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encounters as E
from ..operators import encounters as ops
from ..operators.statistics import histogram_quantiles
from ..sources.derived import ALERTS_SQL, GRID_SQL, OBJECTS_SQL, alerts, grid, objects, table
from .cascade import EVENTS_SQL, links
from .catalog import R6, R9, SEVERITY_SQL, STEPS, query


@query(f"WITH {EVENTS_SQL} SELECT sat1, sat2, arg_min(tca_h, (miss_km, tca_h)) AS tca_h, min(miss_km) AS miss_km FROM links WHERE event IS NULL GROUP BY 1, 2")
def screened_pair_times(spark, sf_dir):
    """Time of the nearest screening alert of every pair; alerts of debris do not count."""
    return links(spark, sf_dir).where("event is null").groupBy("sat1", "sat2").agg(F.min_by("tca_h", F.struct("miss_km", "tca_h")).alias("tca_h"), F.min("miss_km").alias("miss_km"))


FEEDBACK = {"client_s": "CASE WHEN alert_id % 3 = 0 THEN alert_id % 11 / 10e0 END", "client_sat": "CASE WHEN alert_id % 6 = 0 THEN sat2 END", "scalar": "alert_id % 17 / 10e0"}
ADVICE = {"advised_s": "alert_id % 13 / 20e0", "advised_sat": "sat1"}


@query(f"""WITH {ALERTS_SQL}, cache AS (SELECT alert_id, any_value({ADVICE['advised_s']}) AS advised_s, min({ADVICE['advised_sat']}) AS advised_sat FROM alerts WHERE alert_id % 2 = 0 GROUP BY alert_id), asked AS (SELECT alert_id, sat1, {', '.join(f'{e} AS {n}' for n, e in FEEDBACK.items())} FROM alerts)
SELECT alert_id, CASE WHEN advised_sat IS NOT NULL THEN 'advice' WHEN client_s IS NOT NULL THEN 'client' ELSE 'scalar' END AS source, coalesce(advised_sat, CASE WHEN client_s IS NOT NULL THEN client_sat END, sat1) AS sat, coalesce(advised_s, client_s, scalar) AS along_ms FROM asked LEFT JOIN cache USING (alert_id)""")
def feedback_burns(spark, sf_dir):
    """The burn that a decision applies: the alert's own advice, else the client's vector, else the scalar along the track."""
    a = alerts(spark, sf_dir)
    cache = a.where("alert_id % 2 = 0").selectExpr("alert_id", *[f"{e} AS {n}" for n, e in ADVICE.items()]).groupBy("alert_id").agg(F.first("advised_s").alias("advised_s"), F.min("advised_sat").alias("advised_sat"))
    j = a.selectExpr("alert_id", "sat1", *[f"{e} AS {n}" for n, e in FEEDBACK.items()]).join(cache, "alert_id", "left")
    client = F.col("client_s").isNotNull()
    source = F.when(F.col("advised_sat").isNotNull(), "advice").when(client, "client").otherwise("scalar")
    return j.select("alert_id", source.alias("source"), F.coalesce("advised_sat", F.when(client, F.col("client_sat")), "sat1").alias("sat"), F.coalesce("advised_s", "client_s", "scalar").alias("along_ms"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT alert_id, event, sat1, {R9.format('pc')} AS pc9, pc, miss_km FROM links WHERE event IS NOT NULL), top AS (SELECT DISTINCT alert_id, event, sat1, pc9, miss_km FROM d ORDER BY pc9 DESC, miss_km, alert_id LIMIT 50),
x AS (SELECT event, sat1, count(*) AS n, {R9.format('1 - exp(-sum(pc))')} AS aggregate_pc, {R9.format('max(pc)')} AS max_pc FROM d GROUP BY 1, 2) SELECT alert_id, event, sat1, pc9, n, aggregate_pc, max_pc FROM top LEFT JOIN x USING (event, sat1)""")
def debris_alert_aggregates(spark, sf_dir):
    """The fifty likeliest alerts of debris, each with the exposure of its satellite to its event (a top-k list)."""
    d = links(spark, sf_dir).where("event is not null").select("alert_id", "event", "sat1", E.floored(F.col("pc"), 9).alias("pc9"), "pc", "miss_km")
    top = d.select("alert_id", "event", "sat1", "pc9", "miss_km").distinct().orderBy(F.desc("pc9"), "miss_km", "alert_id").limit(50)
    keys = F.broadcast(top.select("event", "sat1").distinct())  # fifty rows at most
    x = d.join(keys, ["event", "sat1"], "left_semi").groupBy("event", "sat1").agg(F.count(F.lit(1)).alias("n"), E.floored(-F.expm1(-F.sum("pc")), 9).alias("aggregate_pc"), E.floored(F.max("pc"), 9).alias("max_pc"))
    return top.join(x, ["event", "sat1"], "left").select("alert_id", "event", "sat1", "pc9", "n", "aggregate_pc", "max_pc")


@query(f"""WITH {OBJECTS_SQL}, s AS (SELECT id, a_km - 6378.137 AS alt, degrees(inc) AS deg, id % 6 = 0 AS debris FROM objects), b AS (SELECT *, floor(alt / 25) AS ab, floor(deg / 2 + 1e-9) AS ib FROM s WHERE alt > 300 AND alt < 2000),
best AS (SELECT ab, ib, count(*) AS n FROM b GROUP BY 1, 2 ORDER BY n DESC, ab, ib LIMIT 1), inside AS (SELECT b.*, n, bool_or(NOT debris) OVER () AS clean FROM b JOIN best USING (ab, ib)), kept AS (SELECT * FROM inside WHERE NOT (clean AND debris)),
m AS (SELECT *, median(alt) OVER () AS ma, median(deg) OVER () AS md FROM kept) SELECT any_value(ab) AS alt_bin, any_value(ib) AS inc_bin, any_value(n) AS n, {R6.format('any_value(ma)')} AS median_km, {R6.format('any_value(md)')} AS median_deg, arg_min(id, (floor((abs(alt - ma) / 25 + abs(deg - md) / 2) * 1e6 + 0.5), id)) AS host FROM m""")
def host_shell(spark, sf_dir):
    """The fullest bin of altitude and inclination, its medians without debris, and the object nearest to them."""
    s = objects(spark, sf_dir).select("id", (F.col("a_km") - 6378.137).alias("alt"), F.degrees("inc").alias("deg"), (F.col("id") % 6 == 0).alias("debris")).where("alt > 300 and alt < 2000")
    b = s.withColumns({"ab": F.floor(F.col("alt") / 25), "ib": F.floor(F.col("deg") / 2 + 1e-9)})
    best = b.groupBy("ab", "ib").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("debris")).alias("clean")).orderBy(F.desc("n"), "ab", "ib").limit(1)
    kept = b.join(F.broadcast(best), ["ab", "ib"]).where("not (clean and debris)")  # one row
    mid = lambda c: histogram_quantiles(kept.select("ab", c), ["ab"], c, [0.5]).select(F.col("q0").alias(f"m_{c}"))
    m = kept.crossJoin(F.broadcast(mid("alt"))).crossJoin(F.broadcast(mid("deg")))  # one row each
    off = F.floor((F.abs(F.col("alt") - F.col("m_alt")) / 25 + F.abs(F.col("deg") - F.col("m_deg")) / 2) * 1e6 + 0.5)
    out = m.groupBy("ab", "ib", "n").agg(F.first("m_alt").alias("a"), F.first("m_deg").alias("d"), F.min_by("id", F.struct(off, "id")).alias("host"))
    return out.select(F.col("ab").cast("double").alias("alt_bin"), F.col("ib").cast("double").alias("inc_bin"), "n", E.floored(F.col("a")).alias("median_km"), E.floored(F.col("d")).alias("median_deg"), "host")


#: Additive contributions of features to the logarithm of a probability.
PARTS = {"miss": "2 - miss_km / 5e0", "speed": "(v_rel - 7e0) / 10e0", "age": "age_h / 100e0 - 1", "tca": "(tca_h - 36e0) / 50e0", "sigma": "sigma_km / 4e0 - 0.6e0", "pair": "(sat2 % 10 - 4) / 20e0", "body": "hbr_km"}
LONG_SQL = "p AS (SELECT alert_id, " + ", ".join(f"{e} AS {n}" for n, e in PARTS.items()) + " FROM alerts)"


@query(f"""WITH {ALERTS_SQL}, {LONG_SQL}, l AS (UNPIVOT (SELECT {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in PARTS)} FROM p) ON {', '.join(PARTS)} INTO NAME feature VALUE v), g AS (SELECT feature, avg(abs(v)) AS a, avg(v) AS s FROM l GROUP BY feature)
SELECT feature, {R6.format('a')} AS mean_abs, {R6.format('s')} AS mean_signed, {R6.format('a / sum(a) OVER ()')} AS share, row_number() OVER (ORDER BY floor(a * 1e6 + 0.5) DESC, feature) AS rank FROM g""")
def contribution_shares(spark, sf_dir):
    """Mean size of each feature's contribution, its share and rank: one aggregate over wide rows, turned afterwards."""
    a = alerts(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in PARTS.items()])
    one = a.agg(*[F.struct(F.lit(n).alias("feature"), F.avg(F.abs(n)).alias("a"), F.avg(n).alias("s")).alias(n) for n in PARTS])
    g = one.select(F.explode(F.array(*PARTS)).alias("g")).select("g.*")
    w = Window.orderBy(F.desc(F.floor(F.col("a") * 1e6 + 0.5)), "feature")  # seven rows
    total = F.sum("a").over(Window.partitionBy(F.lit(1)))
    return g.select("feature", E.floored(F.col("a")).alias("mean_abs"), E.floored(F.col("s")).alias("mean_signed"), E.floored(F.col("a") / total).alias("share"), F.row_number().over(w).alias("rank"))


@query(f"""WITH {ALERTS_SQL}, {LONG_SQL.replace('SELECT alert_id', 'SELECT row_number() OVER () AS row, alert_id', 1)}, l AS (UNPIVOT (SELECT row, alert_id, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in PARTS)} FROM p) ON {', '.join(PARTS)} INTO NAME feature VALUE v), t AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY floor(abs(v) * 1e6 + 0.5) DESC, feature) AS rn FROM l)
SELECT any_value(alert_id) AS alert_id, string_agg(feature || CASE WHEN v < 0 THEN '-' ELSE '+' END, ',' ORDER BY rn) AS top FROM t WHERE rn <= 6 GROUP BY row""")
def contribution_lists(spark, sf_dir):
    """The six largest contributions of every alert with their signs, sorted inside the row."""
    parts = F.array(*[F.struct((-F.floor(F.abs(F.expr(e)) * 1e6 + 0.5)).alias("size"), F.lit(n).alias("feature"), F.when(F.expr(e) < 0, "-").otherwise("+").alias("sign")) for n, e in PARTS.items()])
    top = F.transform(F.slice(F.array_sort(parts), 1, 6), lambda p: F.concat(p["feature"], p["sign"]))
    return alerts(spark, sf_dir).select("alert_id", F.concat_ws(",", top).alias("top"))


SCORED = {"apart": "CASE WHEN alert_id % 5 <> 0 THEN abs(miss_km / 10 - age_h / 100) END", "gone": {"miss": "alert_id % 7 = 0", "age": "age_h > 150", "speed": "alert_id % 11 = 3"}}


@query(f"""WITH {ALERTS_SQL}, s AS (SELECT *, {SCORED['apart']} AS apart FROM alerts) SELECT count(*) AS scored, count(*) FILTER (pc >= 1e-4) AS high, count(*) FILTER (pc >= 1e-6 AND pc < 1e-4) AS elevated, count(apart) AS samples, floor(avg(apart) * 1e3 + 0.5) / 1e3 AS mean_apart, floor(max(apart) * 1e3 + 0.5) / 1e3 AS max_apart, count(*) FILTER (apart > 1) AS over_a_decade,
 {', '.join(f'count(*) FILTER ({e}) AS missing_{n}' for n, e in SCORED['gone'].items())} FROM s""")
def surrogate_counters(spark, sf_dir):
    """Classes, agreement in decades and missing inputs over all scored alerts."""
    s = alerts(spark, sf_dir).withColumn("apart", F.expr(SCORED["apart"]))
    gone = [F.count_if(F.expr(e)).alias(f"missing_{n}") for n, e in SCORED["gone"].items()]
    return s.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("pc") >= 1e-4).alias("high"), F.count_if((F.col("pc") >= 1e-6) & (F.col("pc") < 1e-4)).alias("elevated"), F.count("apart").alias("samples"), E.floored(F.avg("apart"), 3).alias("mean_apart"), E.floored(F.max("apart"), 3).alias("max_apart"), F.count_if(F.col("apart") > 1).alias("over_a_decade"), *gone)


@query("SELECT event_type AS suite, count(*) FILTER (value < 400) AS passed, count(*) AS total, bool_and(value < 400) AS all_pass FROM events GROUP BY ROLLUP (event_type)")
def validation_rollup(spark, sf_dir):
    """Checks passed of each suite and of all (suite null)."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("value") < 400)
    return e.rollup(F.col("event_type").alias("suite")).agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.min("ok").alias("all_pass"))


@query(f"""WITH {OBJECTS_SQL}, {GRID_SQL.format(steps=STEPS)}, d AS (SELECT g.id, g.k, sqrt((g.x-h.x)*(g.x-h.x)+(g.y-h.y)*(g.y-h.y)+(g.z-h.z)*(g.z-h.z)) AS d FROM grid g JOIN grid h ON h.id = 1 AND g.k = h.k AND g.id <> 1)
SELECT id, arg_min(k, (floor(d * 1e6 + 0.5), k)) AS k, {R6.format('min(d)')} AS distance_km FROM d GROUP BY id""")
def first_samples(spark, sf_dir):
    """Sample of the grid at which every object is nearest to one mover, whose track is one row a step."""
    g = grid(objects(spark, sf_dir), STEPS)
    one = F.broadcast(g.where("id = 1").select("k", *[F.col(c).alias(f"{c}1") for c in "xyz"]))  # one row a step
    gap = lambda c: (F.col(c) - F.col(f"{c}1")) * (F.col(c) - F.col(f"{c}1"))
    d = g.where("id <> 1").join(one, "k").select("id", "k", F.sqrt(gap("x") + gap("y") + gap("z")).alias("d"))
    return d.groupBy("id").agg(F.min_by("k", F.struct(F.floor(F.col("d") * 1e6 + 0.5), "k")).alias("k"), E.floored(F.min("d")).alias("distance_km"))


@query(f"""WITH {ALERTS_SQL}, q AS (SELECT DISTINCT alert_id, {SEVERITY_SQL.format(pc='pc', miss='miss_km')} AS severity, {R6.format('CASE WHEN pc <= 0 THEN 0 ELSE greatest(0, least(10, 2 * (log10(pc) + 9))) END')} AS cpi FROM alerts), t AS (SELECT 'ALL' AS tab, * FROM q UNION ALL SELECT severity, * FROM q)
SELECT tab, alert_id, severity, cpi, row_number() OVER (PARTITION BY tab ORDER BY CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END DESC, cpi DESC, alert_id) AS place FROM t QUALIFY place <= 60""")
def alert_queue(spark, sf_dir):
    """The first sixty alerts of each tab, by severity, then index (top-k lists).

    The order names every column, so equal rows share a dense rank: rows are cut to sixty places first and made unique then.
    """
    q = alerts(spark, sf_dir).select("alert_id", E.severity(F.col("pc"), F.col("miss_km")).alias("severity"), E.floored(E.cpi_of_pc(F.col("pc"))).alias("cpi"))
    t = q.withColumn("tab", F.explode(F.array(F.lit("ALL"), F.col("severity"))))
    rank = F.when(F.col("severity") == "CRITICAL", 2).when(F.col("severity") == "WARNING", 1).otherwise(0)
    w = Window.partitionBy("tab").orderBy(F.desc(rank), F.desc("cpi"), "alert_id")
    return t.withColumn("place", F.dense_rank().over(w)).where("place <= 60").select("tab", "alert_id", "severity", "cpi", "place").distinct()  # cut on the map side too


@query(f"WITH {ALERTS_SQL} SELECT {SEVERITY_SQL.format(pc='pc', miss='miss_km')} AS severity, count(*) AS n, count(*) FILTER (pc >= 1e-6) AS to_plan, count(DISTINCT sat1) AS satellites FROM alerts GROUP BY 1")
def alert_counters(spark, sf_dir):
    """Alerts, those to plan for and satellites by severity."""
    a = alerts(spark, sf_dir)
    return a.groupBy(E.severity(F.col("pc"), F.col("miss_km")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pc") >= 1e-6).alias("to_plan"), F.countDistinct("sat1").alias("satellites"))


@query(f"""WITH RECURSIVE t AS (SELECT user_id AS object_id, event_id, epoch_us(ts) // 1000 AS clock, CAST(epoch_us(ts) // 1000 + event_id * 997 % 40000000 AS BIGINT) AS shown FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY clock, event_id) AS rn FROM t),
s AS (SELECT *, CASE WHEN clock - lag(clock) OVER w >= 100 THEN CAST(shown - lag(shown) OVER w AS DOUBLE) / (clock - lag(clock) OVER w) END AS sample FROM o WINDOW w AS (PARTITION BY object_id ORDER BY rn)),
f AS (SELECT object_id, event_id, rn, CAST(1 AS DOUBLE) AS rate FROM s WHERE rn = 1 UNION ALL SELECT s.object_id, s.event_id, s.rn, CASE WHEN s.sample IS NULL OR s.sample <= 0 OR s.sample > 100000 THEN f.rate WHEN s.sample > f.rate * 2 OR s.sample < f.rate / 2 THEN s.sample ELSE f.rate + (s.sample - f.rate) * 0.2 END FROM f JOIN s ON s.object_id = f.object_id AND s.rn = f.rn + 1)
SELECT object_id, event_id, {R6.format('rate')} AS rate FROM f""")
def clock_rates(spark, sf_dir):
    """Rate of a shown clock against the true one, smoothed, with jumps followed at once."""
    clock = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), "event_id", clock.alias("clock"), (clock + F.col("event_id") * 997 % 40000000).alias("shown"))
    return ops.followed_rate(t, "object_id", "clock", "shown", "event_id").select("object_id", "event_id", E.floored(F.col("rate")).alias("rate"))
