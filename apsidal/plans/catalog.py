"""Every query of the library with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encounters as E
from ..operators import encounters as ops
from ..operators.graph import breadth_first
from ..operators.screening import best_candidates, copies, named, overlapping, screened
from ..operators.statistics import histogram_quantiles
from ..sources.derived import ALERTS_SQL, GRID_SQL, OBJECTS_SQL, alerts, grid, objects, table
from ..streaming.telemetry import changes, drained, telemetry_stream, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R6 = "floor(({}) * 1e6 + 0.5) / 1e6"
R9 = "floor(({}) * 1e9 + 0.5) / 1e9"
SEVERITY_SQL = "CASE WHEN {pc} >= 1e-4 OR {miss} < 1 THEN 'CRITICAL' WHEN {pc} >= 1e-6 OR {miss} < 5 THEN 'WARNING' ELSE 'WATCH' END"
STEPS = 31


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DAY = 1441  # steps of a minute over 24 hours, both ends
_C, _S = ("cos(phase1 + n1 * t{i})", "cos(phase2 + n2 * t{i})"), ("sin(phase1 + n1 * t{i})", "sin(phase2 + n2 * t{i})")


def _newton_sql(rounds: int = 6) -> str:
    """Steps of the oracle: slope and curvature of the product of two positions, t0 to t6."""
    out = []
    for i in range(rounds):
        trig = ", ".join(f"{e.format(i=i)} AS {n}{i}" for e, n in ((_C[0], "c1_"), (_C[1], "c2_"), (_S[0], "s1_"), (_S[1], "s2_")))
        c1, c2, s1, s2 = f"c1_{i}", f"c2_{i}", f"s1_{i}", f"s2_{i}"
        slope = f"pp*(-n1*{s1}*{c2} - n2*{c1}*{s2}) + pq*(n2*{c1}*{c2} - n1*{s1}*{s2}) + qp*(n1*{c1}*{c2} - n2*{s1}*{s2}) + qq*(n1*{c1}*{s2} + n2*{s1}*{c2})"
        bend = f"pp*(2*n1*n2*{s1}*{s2} - (n1*n1+n2*n2)*{c1}*{c2}) - pq*((n1*n1+n2*n2)*{c1}*{s2} + 2*n1*n2*{s1}*{c2}) - qp*((n1*n1+n2*n2)*{s1}*{c2} + 2*n1*n2*{c1}*{s2}) + qq*(2*n1*n2*{c1}*{c2} - (n1*n1+n2*n2)*{s1}*{s2})"
        out.append(f"trig{i} AS (SELECT *, {trig} FROM {'newton' if i else 'start'}{i if i else ''}), newton{i + 1} AS (SELECT *, greatest(lo, least(hi, t{i} - CASE WHEN {bend} < 0 THEN ({slope}) / ({bend}) ELSE 0 END)) AS t{i + 1} FROM trig{i})")
    return ",\n".join(out)


SCREEN_SQL = f"""{OBJECTS_SQL}, {GRID_SQL.format(steps=DAY)},
pairs AS (SELECT g.id AS id1, h.id AS id2, g.k, (h.x-g.x)*(h.x-g.x)+(h.y-g.y)*(h.y-g.y)+(h.z-g.z)*(h.z-g.z) AS dd, (h.x-g.x)*(h.vx-g.vx)+(h.y-g.y)*(h.vy-g.vy)+(h.z-g.z)*(h.vz-g.vz) AS dv,
 (h.vx-g.vx)*(h.vx-g.vx)+(h.vy-g.vy)*(h.vy-g.vy)+(h.vz-g.vz)*(h.vz-g.vz) AS vv FROM grid g JOIN grid h ON g.k = h.k AND g.id < h.id),
near AS (SELECT *, CASE WHEN vv > 1e-12 THEN -dv / vv ELSE 0 END AS t FROM pairs WHERE dd <= 504e0 * 504e0), inbin AS (SELECT *, greatest(-30, least(30, t)) AS tstar FROM near WHERE (((t >= -30 AND t < 30) OR (k = {DAY - 1} AND t >= 30)) AND NOT (k = 0 AND t < 0)) OR vv < 0.0025),
linear AS (SELECT * FROM (SELECT id1, id2, k, tstar, sqrt(greatest(0, dd + 2*tstar*dv + tstar*tstar*vv)) AS d_est FROM inbin) WHERE d_est <= 30), few AS (SELECT * FROM linear QUALIFY row_number() OVER (PARTITION BY id1, id2 ORDER BY floor(d_est * 1e3 + 0.5), k) <= 3),
start0 AS (SELECT f.*, k * 60.0 + tstar AS t0, greatest(0, k * 60.0 - 60) AS lo, least({(DAY - 1) * 60.0}, k * 60.0 + 60) AS hi, a.a_km AS a1, b.a_km AS a2, sqrt(398600.8 / (a.a_km*a.a_km*a.a_km)) AS n1, sqrt(398600.8 / (b.a_km*b.a_km*b.a_km)) AS n2, a.phase AS phase1, b.phase AS phase2, a.inc AS i1, b.inc AS i2, a.raan AS o1, b.raan AS o2 FROM few f JOIN objects a ON a.id = id1 JOIN objects b ON b.id = id2),
start AS (SELECT *, cos(o1)*cos(o2) + sin(o1)*sin(o2) AS pp, -cos(o1)*sin(o2)*cos(i2) + sin(o1)*cos(o2)*cos(i2) AS pq, -sin(o1)*cos(i1)*cos(o2) + cos(o1)*cos(i1)*sin(o2) AS qp, sin(o1)*cos(i1)*sin(o2)*cos(i2) + cos(o1)*cos(i1)*cos(o2)*cos(i2) + sin(i1)*sin(i2) AS qq FROM start0),
{_newton_sql()},
ends2 AS (SELECT *, phase1 + n1*t6 AS u1, phase2 + n2*t6 AS u2 FROM newton6), states2 AS (SELECT *, a2*(cos(o2)*cos(u2) - sin(o2)*cos(i2)*sin(u2)) - a1*(cos(o1)*cos(u1) - sin(o1)*cos(i1)*sin(u1)) AS dx, a2*(sin(o2)*cos(u2) + cos(o2)*cos(i2)*sin(u2)) - a1*(sin(o1)*cos(u1) + cos(o1)*cos(i1)*sin(u1)) AS dy, a2*sin(i2)*sin(u2) - a1*sin(i1)*sin(u1) AS dz FROM ends2),
hits AS (SELECT id1, id2, t6 AS tca_s, sqrt(dx*dx + dy*dy + dz*dz) AS miss_km FROM states2 WHERE sqrt(dx*dx + dy*dy + dz*dz) <= 25 AND t6 < {(DAY - 1) * 60.0} - 1e-2),
screened AS (SELECT id1, id2, arg_min(tca_s, (floor(miss_km * 1e6 + 0.5), tca_s)) AS tca_s, min(floor(miss_km * 1e6 + 0.5)) / 1e6 AS miss_km, count(*) AS hits FROM hits GROUP BY 1, 2)"""


@query(f"WITH {SCREEN_SQL} SELECT id1, id2, floor(tca_s * 10 + 0.5) / 10 AS tca_s, miss_km, hits, {SEVERITY_SQL.format(pc='least(1, exp(-miss_km*miss_km/0.5) * (1 - exp(-0.0002)))', miss='miss_km')} AS severity FROM screened")
def screening(spark, sf_dir):
    """The flagship: best encounter within 25 km of every pair of objects over 24 hours in steps of a minute."""
    best = screened(objects(spark, sf_dir), DAY, 60.0, 25.0)
    miss = E.floored(F.col("miss_km"))
    pc = F.least(F.lit(1.0), F.exp(-miss * miss / 0.5) * (1 - F.exp(F.lit(-0.0002))))  # half a kilometre of deviation, ten metres of radius
    return best.select("id1", "id2", E.floored(F.col("tca_s"), 1).alias("tca_s"), miss.alias("miss_km"), "hits", E.severity(pc, miss).alias("severity"))


@query(f"WITH {OBJECTS_SQL}, s AS (SELECT id, a_km - 0.6 AS low, a_km + 0.6 AS high FROM objects) SELECT DISTINCT a.id FROM s a JOIN s b ON a.id <> b.id AND a.low <= b.high AND b.low <= a.high")
def shell_prefilter(spark, sf_dir):
    """Objects whose radial interval meets another's."""
    s = objects(spark, sf_dir).select("id", (F.col("a_km") - 0.6).alias("low"), (F.col("a_km") + 0.6).alias("high"))
    return overlapping(s, 10.0).select("id")


@query(f"WITH {SCREEN_SQL} SELECT id1, id2, k, floor(d_est * 1e3 + 0.5) / 1e3 AS d_est FROM few")
def capped_candidates(spark, sf_dir):
    """The three best linear estimates of every pair."""
    first, names = copies(objects(spark, sf_dir))
    c = named(best_candidates(first, DAY, 60.0, 25.0), names)
    return c.select("id1", "id2", "k", E.floored(F.col("d_est"), 3).alias("d_est"))


@query(f"""WITH {ALERTS_SQL},
parts AS (SELECT *, CASE WHEN miss_km <= 0.1 THEN 10.0 WHEN miss_km <= 1 THEN 9 - (miss_km - 0.1) * 2 / 0.9 WHEN miss_km <= 10 THEN 7 - (miss_km - 1) * 3 / 9 WHEN miss_km <= 50 THEN 4 - (miss_km - 10) * 2 / 40 WHEN miss_km <= 200 THEN 2 - (miss_km - 50) * 1.5 / 150 ELSE greatest(0.0, 0.5 - (miss_km - 200) * 0.001) END AS m,
 CASE WHEN pc <= 0 THEN 0.0 WHEN pc >= 1e-2 THEN 10.0 ELSE greatest(0.0, least(10.0, (log10(greatest(pc, 1e-20)) + 6) / 0.4)) END AS p,
 CASE WHEN tca_h <= 1 THEN 10.0 WHEN tca_h <= 6 THEN 10 - (tca_h - 1) * 0.8 WHEN tca_h <= 24 THEN 6 - (tca_h - 6) * 4 / 18 ELSE greatest(0.0, 2 - (tca_h - 24) * 0.05) END AS t,
 greatest(0.0, least(10.0, v_rel / 15 * 10)) AS s, greatest(0.0, least(10.0, age_h / 168 * 10)) AS g FROM alerts)
SELECT alert_id, {R9.format('pc')} AS pc, {SEVERITY_SQL.format(pc='pc', miss='miss_km')} AS severity, CASE WHEN pc >= 1e-4 THEN 'high' WHEN pc >= 1e-6 THEN 'elevated' ELSE 'low' END AS risk,
 CASE WHEN pc >= 1e-4 THEN 'MANOEUVRE' WHEN pc >= 1e-5 THEN 'PREPARE' WHEN pc >= 1e-7 THEN 'MONITOR' ELSE 'NONE' END AS action, {R6.format('m * 0.4 + p * 0.3 + t * 0.15 + s * 0.1 + g * 0.05')} AS cpi FROM parts""")
def alert_scores(spark, sf_dir):
    """Probability, severity, risk class, action tier and conjunction index of every alert."""
    a, c = alerts(spark, sf_dir), F.col
    cpi = E.conjunction_index(c("miss_km"), c("pc"), c("tca_h"), c("v_rel"), c("age_h"))
    return a.select("alert_id", E.floored(c("pc"), 9).alias("pc"), E.severity(c("pc"), c("miss_km")).alias("severity"), E.risk_class(c("pc")).alias("risk"), E.action_tier(c("pc")).alias("action"), E.floored(cpi).alias("cpi"))


@query("""SELECT p_partkey AS id, CASE WHEN upper(p_name) LIKE '%DEB%' THEN 'DEB' WHEN upper(p_name) LIKE '%R/B%' THEN 'R/B' WHEN p_name = '' THEN 'UNK' ELSE 'PAY' END AS object_type,
 CASE WHEN p_size / 25.0 < 0.1 THEN 'SMALL' WHEN p_size / 25.0 < 1 THEN 'MEDIUM' ELSE 'LARGE' END AS rcs_class,
 CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 2 % 24 + 10) * 10000 + p_partkey % 10000 ELSE p_partkey % 10000 END AS catalogue_number FROM part""")
def object_metadata(spark, sf_dir):
    """Type from the name, size class from the cross-section, number from its five-character field."""
    p = table(spark, sf_dir, "part")
    digits = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    field = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), (F.floor(F.col("p_partkey") / 2) % 24 + 1).cast("int"), F.lit(1)), digits)).otherwise(F.concat(F.lit("0"), digits))
    return p.select(F.col("p_partkey").alias("id"), E.object_type(F.col("p_name")).alias("object_type"), E.rcs_class(F.col("p_size") / 25.0).alias("rcs_class"), E.catalogue_number(field).cast("long").alias("catalogue_number"))


@query("SELECT c_custkey AS id, coalesce(n_name, 'Unknown') AS owner, coalesce(r_name, 'Unknown') AS agency, c_mktsegment IN ('BUILDING', 'MACHINERY') AS refined FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def owner_lookup(spark, sf_dir):
    """Left lookups against two dimensions of a fixed number of rows."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = F.broadcast(n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left"))
    c = table(spark, sf_dir, "customer")
    return c.join(dim, c["c_nationkey"] == dim["n_nationkey"], "left").select(F.col("c_custkey").alias("id"), F.coalesce("n_name", F.lit("Unknown")).alias("owner"), F.coalesce("r_name", F.lit("Unknown")).alias("agency"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("refined"))


ENDS_SQL = "ends AS (SELECT sat1 AS sat, * FROM alerts UNION ALL SELECT sat2 AS sat, * FROM alerts)"


@query(f"WITH {ALERTS_SQL}, {ENDS_SQL} SELECT sat, {R9.format('1 - exp(sum(ln(1 - least(pc, 1 - 1e-15))))')} AS p_hit, count(*) AS n_alerts FROM ends GROUP BY sat")
def hit_probability(spark, sf_dir):
    return ops.node_hit_probability(alerts(spark, sf_dir))


@query(f"""WITH {ALERTS_SQL}, {ENDS_SQL}
SELECT alert_id % 7 AS event, sat, count(*) AS n, {R6.format('sum(1 + alert_id % 4)')} AS fragments, {R9.format('1 - exp(-sum((1 + alert_id % 4) * pc))')} AS aggregate_pc, {R9.format('max(pc)')} AS max_pc, min(miss_km) AS min_miss_km, (array_agg(tca_h ORDER BY miss_km, alert_id))[1] AS tca_of_min_h, min(tca_h) AS first_tca_h,
 {SEVERITY_SQL.format(pc='1 - exp(-sum((1 + alert_id % 4) * pc))', miss='min(miss_km)')} AS severity FROM ends GROUP BY 1, 2""")
def debris_exposure(spark, sf_dir):
    """Exposure of every satellite to each event; a sampled fragment stands for one to four."""
    return ops.exposure(alerts(spark, sf_dir), F.col("alert_id") % 7, (1 + F.col("alert_id") % 4).cast("double"))


@query(f"""WITH {ALERTS_SQL}, {ENDS_SQL}, r AS (SELECT sat, alert_id, {R9.format('pc')} AS pc9, miss_km FROM ends)
SELECT sat, alert_id, pc9, miss_km, row_number() OVER (PARTITION BY sat ORDER BY pc9 DESC, miss_km, alert_id) AS rank FROM r QUALIFY rank <= 5""")
def top_alerts(spark, sf_dir):
    return ops.top_alerts(alerts(spark, sf_dir), 5)


@query(f"""WITH {ALERTS_SQL}, p AS (SELECT * FROM alerts WHERE alert_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY sat1, sat2 ORDER BY alert_id) = 1),
e AS (SELECT * FROM alerts WHERE alert_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY sat1, sat2 ORDER BY alert_id) = 1)
SELECT coalesce(p.sat1, e.sat1) AS sat1, coalesce(p.sat2, e.sat2) AS sat2, coalesce(p.alert_id, e.alert_id) AS alert_id, coalesce(p.miss_km, e.miss_km) AS miss_km, CASE WHEN p.sat1 IS NULL THEN 'graph' WHEN e.sat1 IS NULL THEN 'physics' ELSE 'both' END AS origin
FROM p FULL JOIN e ON p.sat1 = e.sat1 AND p.sat2 = e.sat2""")
def alert_merge(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return ops.merged(a.where("alert_id % 3 <> 0"), a.where("alert_id % 3 = 0"))


@query(f"""WITH {ALERTS_SQL}, b AS (SELECT sat1, sat2, max(pc) AS pb, min(miss_km) AS mb FROM alerts WHERE alert_id % 2 = 0 GROUP BY 1, 2), a AS (SELECT sat1, sat2, max(pc) AS pa, min(miss_km) AS ma FROM alerts WHERE alert_id % 2 = 1 GROUP BY 1, 2)
SELECT sat1, sat2, pb IS NULL AS is_new, {R9.format('pa')} AS pc_after, ma AS miss_after, pa >= 1e-6 OR ma < 1 AS unsafe FROM a LEFT JOIN b USING (sat1, sat2) WHERE pb IS NULL OR pa > 1.1 * pb OR ma < 0.9 * mb""")
def worsened_secondaries(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return ops.worsened(a.where("alert_id % 2 = 0"), a.where("alert_id % 2 = 1"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'P' THEN 'MODIFY' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'LATER' ELSE 'REJECT' END END AS v FROM orders), k AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 10 AS round, v FROM d WHERE v <> 'LATER'), r AS (SELECT round, avg(CASE WHEN v <> 'REJECT' THEN 1.0 ELSE 0.0 END) AS r FROM k GROUP BY round HAVING count(*) = 10)
SELECT round, floor(r * 1e6 + 0.5) / 1e6 AS approval_rate FROM r QUALIFY row_number() OVER (ORDER BY round DESC) <= 20""")
def feedback_rounds(spark, sf_dir):
    """Approval in the last complete rounds of ten decisions; unknown verdicts are not recorded."""
    return ops.feedback_rounds(decisions(spark, sf_dir))


def decisions(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "APPROVE").when(F.col("o_orderstatus") == "P", "MODIFY").otherwise(F.when(F.col("o_orderkey") % 5 == 0, "LATER").otherwise("REJECT"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), verdict.alias("verdict"))


@query("""SELECT count(*) AS n, count(*) FILTER (v = 'APPROVE') AS approved, count(*) FILTER (v = 'MODIFY') AS modified, count(*) FILTER (v = 'REJECT') AS rejected, floor(avg(CASE WHEN v <> 'REJECT' THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS approval_rate
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'P' THEN 'MODIFY' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'LATER' ELSE 'REJECT' END END AS v FROM orders) WHERE v <> 'LATER'""")
def feedback_totals(spark, sf_dir):
    """Verdicts in total."""
    d = decisions(spark, sf_dir).where(F.col("verdict").isin(*ops.VERDICTS))
    of = lambda v: F.count_if(F.col("verdict") == v)
    return d.agg(F.count(F.lit(1)).alias("n"), of("APPROVE").alias("approved"), of("MODIFY").alias("modified"), of("REJECT").alias("rejected"), E.floored(F.avg(F.when(F.col("verdict") != "REJECT", 1.0).otherwise(0.0))).alias("approval_rate"))


def telemetry(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("object_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")


@query(f"""WITH w AS (SELECT event_id, user_id AS object_id, value, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, count(value) OVER p AS n FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, object_id, CASE WHEN n < 2 OR s < 1e-6 THEN 0 ELSE {R6.format('(value - m) / s')} END AS z, n >= 2 AND s >= 1e-6 AND (value - m) / s >= 3 AS anomalous FROM w""")
def residual_scores(spark, sf_dir):
    return ops.rolling_score(telemetry(spark, sf_dir))


@query("""SELECT l.user_id AS object_id, l.event_id, r.value AS last_value FROM (SELECT * FROM events WHERE event_id % 2 = 0) l ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def settled_predictions(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return ops.as_of(t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1"), "object_id", "ts", "value", "event_id")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id AS object_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000) AS BIGINT) AS seconds FROM s GROUP BY 1, 2""")
def contact_sessions(spark, sf_dir):
    return ops.sessions(telemetry(spark, sf_dir), 86400)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2")
def stream_daily_windows(spark, sf_dir):
    """A file stream through watermarked tumbling windows, drained once."""
    rows = drained(windowed(telemetry_stream(spark, sf_dir), "1 day"), "update", ["start", "event_type"])
    return rows.select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n", "max_value")


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start FROM events) SELECT strftime(start, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, max(value) AS max_value FROM w GROUP BY 1, 2""")
def stream_sliding_windows(spark, sf_dir):
    """Windows of a day that slide by half a day."""
    rows = drained(windowed(telemetry_stream(spark, sf_dir), "1 day", "12 hours"), "update", ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "max_value")


@query("""SELECT object_id, event_id, stamp FROM (SELECT user_id AS object_id, event_id, event_type AS stamp, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS DISTINCT FROM stamp""")
def stream_changes(spark, sf_dir):
    """Only what changes a stamp is emitted."""
    return drained(changes(telemetry_stream(spark, sf_dir)), "append")


@query("""WITH g AS (SELECT user_id AS object_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 28800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT object_id, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts)) + 28800000000 AS expires_us, count(*) AS n FROM s GROUP BY object_id, k""")
def session_windows(spark, sf_dir):
    """Sessions that expire eight hours after the last contact."""
    s = telemetry(spark, sf_dir).groupBy("object_id", F.session_window("ts", "8 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("object_id", F.unix_micros("session_window.start").alias("opened_us"), F.unix_micros("session_window.end").alias("expires_us"), "n")


@query(f"""WITH {OBJECTS_SQL}, {GRID_SQL.format(steps=STEPS)}, d AS (SELECT g.id, g.k, sqrt((g.x-h.x)*(g.x-h.x)+(g.y-h.y)*(g.y-h.y)+(g.z-h.z)*(g.z-h.z)) AS d FROM grid g JOIN grid h ON g.k = h.k AND h.id = 1 AND g.id <> 1),
n AS (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS a FROM d WINDOW w AS (PARTITION BY id ORDER BY k)) SELECT id, k, {R6.format('d')} AS distance_km FROM n WHERE d <= b AND d <= a""")
def distance_minima(spark, sf_dir):
    """Local minima of the distance to one object, whose track is one row a step."""
    g = grid(objects(spark, sf_dir), STEPS)
    one = F.broadcast(g.where("id = 1").select("k", *[F.col(c).alias(f"{c}1") for c in "xyz"]))
    d = g.where("id <> 1").join(one, "k").select("id", "k", F.sqrt(sum(((F.col(c) - F.col(f"{c}1")) * (F.col(c) - F.col(f"{c}1")) for c in "yz"), (F.col("x") - F.col("x1")) * (F.col("x") - F.col("x1")))).alias("d"))
    w = Window.partitionBy("id").orderBy("k")
    return d.withColumns({"b": F.lag("d").over(w), "a": F.lead("d").over(w)}).where("d <= b AND d <= a").select("id", "k", E.floored(F.col("d")).alias("distance_km"))


@query(f"""WITH {OBJECTS_SQL}, {GRID_SQL.format(steps=STEPS)}, c AS (SELECT id % 3 AS cloud, k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM grid GROUP BY 1, 2),
d AS (SELECT c.cloud, c.k, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d FROM grid JOIN c ON grid.id % 3 = c.cloud AND grid.k = c.k)
SELECT cloud, k, count(*) AS n, {R6.format('quantile_cont(d, 0.5)')} AS p50_km, {R6.format('quantile_cont(d, 0.9)')} AS p90_km, {R6.format('max(d)')} AS max_km FROM d GROUP BY 1, 2 HAVING count(*) >= 3""")
def cloud_statistics(spark, sf_dir):
    """Spread of each cloud around its centroid per step: an aggregate, a join back, an aggregate."""
    g = grid(objects(spark, sf_dir), STEPS).withColumn("cloud", F.col("id") % 3)
    c = g.groupBy("cloud", "k").agg(*[F.avg(n).alias(f"c{n}") for n in "xyz"])
    d = g.join(c, ["cloud", "k"]).withColumn("d", F.sqrt(sum(((F.col(n) - F.col(f"c{n}")) * (F.col(n) - F.col(f"c{n}")) for n in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))))
    out = histogram_quantiles(d, ["cloud", "k"], "d", [0.5, 0.9, 1.0]).where("n >= 3").toDF("cloud", "k", "n", "a", "b", "m")
    return out.select("cloud", "k", "n", E.floored(F.col("a")).alias("p50_km"), E.floored(F.col("b")).alias("p90_km"), E.floored(F.col("m")).alias("max_km"))


@query(f"""WITH RECURSIVE {ALERTS_SQL}, e AS (SELECT DISTINCT sat1 AS a, sat2 AS b FROM alerts), ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(node, hops) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT ab.b, min(walk.hops) + 1 FROM walk JOIN ab ON ab.a = walk.node LEFT JOIN recurring.walk AS seen ON seen.node = ab.b WHERE seen.node IS NULL GROUP BY ab.b)
SELECT node, hops FROM walk""")
def cascade_depth(spark, sf_dir):
    """Hops of every object from an event at object 1, by frontier rounds."""
    edges = alerts(spark, sf_dir).select(F.col("sat1").alias("a"), F.col("sat2").alias("b"))
    return breadth_first(edges, spark.range(1, 2).select(F.col("id").alias("node"))).select("node", "hops")


@query("SELECT p_name || ' ' || p_partkey % 100 AS name, min(p_size) AS owner FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1")
def unambiguous_owners(spark, sf_dir):
    """Names that belong to one owner only."""
    g = table(spark, sf_dir, "part").groupBy(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 100).cast("string")).alias("name"))
    return g.agg(F.min("p_size").alias("owner"), F.max("p_size").alias("last")).where("owner = last").select("name", "owner")


@query("""WITH p AS (SELECT quality, toxic FROM labels), c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM p)
SELECT tp, fp, fn, tn, floor(2 * tp / nullif(2 * tp + fp + fn, 0) * 1e6 + 0.5) / 1e6 AS f1, floor(tp / nullif(tp + fp, 0) * 1e6 + 0.5) / 1e6 AS precision, floor(tp / nullif(tp + fn, 0) * 1e6 + 0.5) / 1e6 AS recall FROM c""")
def classification_metrics(spark, sf_dir):
    of = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    c = table(spark, sf_dir, "labels").agg(of(1, 0).alias("tp"), of(0, 0).alias("fp"), of(1, 1).alias("fn"), of(0, 1).alias("tn"))
    ratio = lambda d: E.floored(F.col("tp") / F.nullif(F.col("tp") + F.col(d), F.lit(0)))
    f1 = E.floored(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))
    return c.select("tp", "fp", "fn", "tn", f1.alias("f1"), ratio("fp").alias("precision"), ratio("fn").alias("recall"))


@query(f"WITH {ALERTS_SQL} SELECT {R6.format('corr(miss_km, sigma_km)')} AS miss_sigma, {R6.format('corr(v_rel, tca_h)')} AS speed_tca, count(*) AS n FROM alerts")
def feature_correlation(spark, sf_dir):
    return alerts(spark, sf_dir).agg(E.floored(F.corr("miss_km", "sigma_km")).alias("miss_sigma"), E.floored(F.corr("v_rel", "tca_h")).alias("speed_tca"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {ALERTS_SQL} SELECT CAST(floor(miss_km / 2.5) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (v_rel > 7.5) AS fast FROM alerts GROUP BY 1")
def miss_histogram(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy(F.floor(F.col("miss_km") / 2.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v_rel") > 7.5).alias("fast"))


@query(f"""WITH {ALERTS_SQL}, {ENDS_SQL} SELECT s_suppkey AS id, arg_max(e.sigma_km, (e.tca_h, e.alert_id)) AS sigma_km FROM supplier LEFT JOIN ends e ON e.sat = s_suppkey GROUP BY 1""")
def covariance_lookup(spark, sf_dir):
    """Latest uncertainty of each object, aggregated before the join."""
    last = ops.endpoints(alerts(spark, sf_dir), "sigma_km", "tca_h", "alert_id").groupBy("sat").agg(F.max_by("sigma_km", F.struct("tca_h", "alert_id")).alias("sigma_km"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.join(last, s["id"] == last["sat"], "left").select("id", "sigma_km")


