"""Queries over single encounters: scores, bands, decisions, B-plane probabilities, features, display."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import encounters as E
from ..functions import kernels
from ..sources.derived import ALERTS_SQL, alerts
from .catalog import R6, R9, query

#: B-plane geometry and the inputs of a decision, in SQL that both engines read.
PLANE = {"b_t": "miss_km * cos(alert_id % 628 / 100e0)", "b_n": "miss_km * sin(alert_id % 628 / 100e0)", "ell_a": "sigma_km * 3000e0", "ell_b": "sigma_km * 3000e0 / (1 + alert_id % 5)", "ell_angle": "alert_id % 314 / 100e0"}
CASE = {"pc_ml": "CASE WHEN alert_id % 4 <> 0 THEN least(1e0, pc * pow(10e0, (alert_id % 7 - 3) / 1.9e0)) END", "downstream": "CAST(alert_id % 12 AS DOUBLE)", "dv": "CASE WHEN alert_id % 3 <> 0 THEN alert_id % 30 / 10e0 END", "safe": "alert_id % 5 <> 0", "spread": "CASE WHEN alert_id % 6 <> 0 THEN alert_id % 16 / 10e0 END", "short_ok": "v_rel >= 1e0"}
part = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
S1, S2 = "(ell_a * 1e-3 / 3)", "(ell_b * 1e-3 / 3)"
PLANE_SQL = f"""{ALERTS_SQL}, plane0 AS (SELECT *, {part(PLANE)} FROM alerts), plane AS (SELECT *, cos(ell_angle) * cos(ell_angle) * {S1} * {S1} + sin(ell_angle) * sin(ell_angle) * {S2} * {S2} AS c_tt, cos(ell_angle) * sin(ell_angle) * ({S1} * {S1} - {S2} * {S2}) AS c_tn, sin(ell_angle) * sin(ell_angle) * {S1} * {S1} + cos(ell_angle) * cos(ell_angle) * {S2} * {S2} AS c_nn FROM plane0)"""


def plane(spark, sf_dir):
    a = alerts(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in PLANE.items()])
    cov = E.ellipse_covariance(F.col("ell_a"), F.col("ell_b"), F.col("ell_angle"), F.lit(3.0))
    return a.withColumns(dict(zip(("c_tt", "c_tn", "c_nn"), cov, strict=True)))


@query(f"WITH {PLANE_SQL} SELECT alert_id, {R6.format('c_tt')} AS c_tt, {R6.format('c_tn')} AS c_tn, {R6.format('c_nn')} AS c_nn, {R6.format('(c_nn*b_t*b_t - 2*c_tn*b_t*b_n + c_tt*b_n*b_n) / (c_tt*c_nn - c_tn*c_tn)')} AS q FROM plane WHERE c_tt*c_nn - c_tn*c_tn > 0 AND alert_id % 9 <> 0")
def bplane_inputs(spark, sf_dir):
    """Covariance of the published ellipse; rows without a miss vector or with a singular covariance go."""
    p = plane(spark, sf_dir).withColumn("b_t", F.when(F.col("alert_id") % 9 != 0, F.col("b_t")))
    p = p.where(F.col("b_t").isNotNull() & (F.col("c_tt") * F.col("c_nn") - F.col("c_tn") * F.col("c_tn") > 0))
    c = [F.col(n) for n in ("b_t", "b_n", "c_tt", "c_tn", "c_nn")]
    return p.select("alert_id", *[E.floored(F.col(n)).alias(n) for n in ("c_tt", "c_tn", "c_nn")], E.floored(E.mahalanobis(*c)).alias("q"))


_X, _W = np.polynomial.legendre.leggauss(8)
NODES_SQL = "radial(x, w) AS (VALUES " + ", ".join(f"({float((x + 1) / 2)!r}e0, {float(w / 2)!r}e0)" for x, w in zip(_X, _W, strict=True)) + "), angles AS (SELECT unnest(range(0, 24)) * 2 * pi() / 24 AS t), nodes AS (SELECT x * cos(t) AS px, x * sin(t) AS py, x * w * 2 * pi() / 24 AS pw FROM radial, angles)"


@query(f"""WITH {PLANE_SQL}, {NODES_SQL} SELECT any_value(alert_id) AS alert_id, {R9.format('sum(exp(-0.5 * (c_nn*(px*hbr_km-b_t)*(px*hbr_km-b_t) - 2*c_tn*(px*hbr_km-b_t)*(py*hbr_km-b_n) + c_tt*(py*hbr_km-b_n)*(py*hbr_km-b_n)) / (c_tt*c_nn - c_tn*c_tn)) * pw) * any_value(hbr_km) * any_value(hbr_km) / (2 * pi() * sqrt(any_value(c_tt*c_nn - c_tn*c_tn)))')} AS pc FROM (SELECT *, row_number() OVER () AS line FROM plane), nodes GROUP BY line""")
def disk_integral(spark, sf_dir):
    """Probability of every encounter by integrating its B-plane Gaussian over the hard-body disk."""
    return kernels.with_disk_probability(plane(spark, sf_dir)).select("alert_id", E.floored(F.col("pc_quad"), 9).alias("pc"))


CHAN_SQL = "list_sum(list_transform(range(0, 24), lambda m: exp(-lam + CASE WHEN m > 0 THEN m * ln(greatest(lam, 1e-300)) ELSE 0 END - lgamma(m + 1) + (m + 1) * ln(x) - x - lgamma(m + 2)) * (1 + x / (m + 2) + x * x / ((m + 2) * (m + 3)) + x * x * x / ((m + 2) * (m + 3) * (m + 4)))))"


@query(f"""WITH {PLANE_SQL}, {NODES_SQL}, f AS (SELECT any_value(alert_id) AS alert_id, sum(exp(-0.5 * (c_nn*(px*hbr_km-b_t)*(px*hbr_km-b_t) - 2*c_tn*(px*hbr_km-b_t)*(py*hbr_km-b_n) + c_tt*(py*hbr_km-b_n)*(py*hbr_km-b_n)) / (c_tt*c_nn - c_tn*c_tn)) * pw) * any_value(hbr_km) * any_value(hbr_km) / (2 * pi() * sqrt(any_value(c_tt*c_nn - c_tn*c_tn))) AS foster, any_value((c_nn*b_t*b_t - 2*c_tn*b_t*b_n + c_tt*b_n*b_n) / (c_tt*c_nn - c_tn*c_tn)) / 2 AS lam, any_value(hbr_km * hbr_km / sqrt(c_tt*c_nn - c_tn*c_tn)) / 2 AS x FROM (SELECT *, row_number() OVER () AS line FROM plane), nodes GROUP BY line),
c AS (SELECT *, {CHAN_SQL} AS chan, CASE WHEN lam <= 0 THEN 1 ELSE least(1, x / (exp(1) * lam)) END AS largest FROM f)
SELECT alert_id, {R9.format('chan')} AS chan, {R9.format('largest')} AS largest, floor(abs(log10(greatest(foster, 1e-20)) - log10(greatest(chan, 1e-20))) * 1e3 + 0.5) / 1e3 AS spread, abs(log10(greatest(foster, 1e-20)) - log10(greatest(chan, 1e-20))) <= 0.5 AS consistent FROM c""")
def probability_checks(spark, sf_dir):
    """The series beside the integral, the largest probability in closed form, their spread in decades."""
    p = kernels.with_probability_checks(plane(spark, sf_dir), largest=False)
    c = [F.col(n) for n in ("b_t", "b_n", "c_tt", "c_tn", "c_nn", "hbr_km")]
    spread = F.abs(E.log10_floor(F.col("foster")) - E.log10_floor(F.col("chan")))
    return p.select("alert_id", E.floored(F.col("chan"), 9).alias("chan"), E.floored(E.largest_pc(*c), 9).alias("largest"), E.floored(spread, 3).alias("spread"), (spread <= 0.5).alias("consistent"))


@query(f"""WITH {ALERTS_SQL}, c AS (SELECT *, {part(CASE)} FROM alerts), t AS (SELECT *, 1 - exp(-downstream / 5) AS nc, CASE WHEN dv IS NULL THEN 0 ELSE exp(-greatest(dv, 0)) * CASE WHEN safe THEN 1 ELSE 0.5 END END AS nm, CASE WHEN pc > 0 THEN greatest(0, least(1, (log10(pc) + 7) / 3)) ELSE 0 END AS np, CASE WHEN pc_ml > 0 THEN greatest(0, least(1, (log10(pc_ml) + 7) / 3)) ELSE 0 END AS nl,
 CASE WHEN pc >= 1e-4 THEN 'MANOEUVRE' WHEN pc >= 1e-5 THEN 'PREPARE' WHEN pc >= 1e-7 THEN 'MONITOR' ELSE 'NONE' END AS tier, abs(log10(greatest(pc, 1e-20)) - log10(greatest(pc_ml, 1e-20))) AS apart FROM c),
e AS (SELECT *, coalesce(tier = 'PREPARE' AND pc_ml >= 1e-4 AND nc >= 0.5, false) AS escalated, CASE WHEN short_ok AND spread <= 0.5 AND apart <= 1 THEN 'high' WHEN short_ok AND coalesce(spread, 0) <= 1 AND (apart IS NULL OR apart <= 2) THEN 'medium' ELSE 'low' END AS confidence FROM t)
SELECT alert_id, floor(100 * (np * CASE WHEN pc_ml IS NULL THEN 0.75 ELSE 0.6 END + CASE WHEN pc_ml IS NULL THEN 0 ELSE nl * 0.15 END + nc * 0.15 + nm * 0.1) * 100 + 0.5) / 100 AS score, CASE WHEN escalated THEN 'MANOEUVRE' ELSE tier END AS action, escalated, confidence,
 concat_ws('; ', 'in the ' || tier || ' band', CASE WHEN pc_ml IS NULL THEN 'no surrogate (weight moved to physics)' ELSE printf('%.2f', floor(apart * 100 + 0.5) / 100) || ' decades from physics' END, CASE WHEN spread IS NOT NULL THEN 'spread ' || printf('%.2f', floor(spread * 100 + 0.5) / 100) || ' decades' END, CAST(downstream AS INT) || ' downstream object' || CASE WHEN downstream = 1 THEN '' ELSE 's' END,
 CASE WHEN dv IS NOT NULL THEN 'verified manoeuvre ' || printf('%.3f', floor(dv * 1000 + 0.5) / 1000) || ' m/s' || CASE WHEN safe THEN '' ELSE ' (not cascade-safe)' END END) || ' -> ' || CASE WHEN escalated THEN 'MANOEUVRE (escalated)' ELSE tier END || ', confidence ' || confidence AS rationale FROM e""")
def decisions_of_alerts(spark, sf_dir):
    """Score, action, escalation, confidence and rationale of every alert."""
    a = alerts(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in CASE.items()])
    d = E.decision(*[F.col(n) for n in ("pc", "pc_ml", "downstream", "dv", "safe", "spread", "short_ok")])
    return a.select("alert_id", *[c.alias(n) for n, c in d.items()])


@query(f"""WITH {ALERTS_SQL}, c AS (SELECT *, {part(CASE)} FROM alerts), t AS (SELECT CASE WHEN coalesce(pc >= 1e-5 AND pc < 1e-4 AND pc_ml >= 1e-4 AND 1 - exp(-downstream / 5) >= 0.5, false) OR pc >= 1e-4 THEN 'MANOEUVRE' WHEN pc >= 1e-5 THEN 'PREPARE' WHEN pc >= 1e-7 THEN 'MONITOR' ELSE 'NONE' END AS action, pc_ml, spread FROM c)
SELECT action, count(*) AS n, count(pc_ml) AS with_surrogate, count(*) FILTER (spread > 0.5) AS inconsistent FROM t GROUP BY action""")
def decision_statistics(spark, sf_dir):
    a = alerts(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in CASE.items()])
    d = E.decision(*[F.col(n) for n in ("pc", "pc_ml", "downstream", "dv", "safe", "spread", "short_ok")])
    return a.groupBy(d["action"].alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count("pc_ml").alias("with_surrogate"), F.count_if(F.col("spread") > 0.5).alias("inconsistent"))


WORD = "CASE alert_id % 11 WHEN 0 THEN 'red' WHEN 1 THEN 'Amber' WHEN 2 THEN 'NOMINAL' WHEN 3 THEN 'critical' WHEN 4 THEN 'odd' WHEN 5 THEN 'Orange' END"


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT *, {WORD} AS word, alert_id % 10 AS cpi FROM alerts) SELECT alert_id, CASE WHEN miss_km * 20 <= 50 THEN 'red' WHEN miss_km * 20 <= 200 THEN 'yellow' WHEN miss_km * 20 <= 500 THEN 'green' ELSE 'none' END AS band,
 CASE WHEN upper(word) IN ('RED', 'CRITICAL') THEN 'CRITICAL' WHEN upper(word) IN ('AMBER', 'ORANGE') THEN 'WARNING' WHEN upper(word) = 'NOMINAL' THEN 'WATCH' WHEN cpi >= 8 THEN 'CRITICAL' WHEN cpi >= 5 THEN 'WARNING' ELSE 'WATCH' END AS tier, CASE WHEN miss_km * 500 <= 1 THEN 'collision' WHEN miss_km * 500 <= 5000 THEN 'warning' ELSE 'clear' END AS approach,
 {R6.format('CASE WHEN pc <= 0 THEN 0 ELSE greatest(0, least(10, 2 * (log10(pc) + 9))) END')} AS cpi_of_pc, {R6.format('CASE WHEN pc > 0 THEN greatest(0, least(1, (log10(pc) + 7) / 3)) ELSE 0 END')} AS pc_norm, {R6.format('0.1 + 0.1 * age_h / 24')} AS sigma_r, {R6.format('0.5 + age_h / 24')} AS sigma_t, {R6.format('0.15 + 0.1 * age_h / 24')} AS sigma_n FROM t""")
def alert_bands(spark, sf_dir):
    """Distance bands, client severity words, approach classes, indices of the probability, deviations by age."""
    a = alerts(spark, sf_dir).selectExpr("*", f"{WORD} AS word", "alert_id % 10 AS cpi")
    r, t, n = (E.floored(s) for s in E.age_sigmas(F.col("age_h") / 24))
    return a.select("alert_id", E.legacy_band(F.col("miss_km") * 20).alias("band"), E.tier_of(F.col("word"), F.col("cpi")).alias("tier"), E.approach(F.col("miss_km") * 500).alias("approach"), E.floored(E.cpi_of_pc(F.col("pc"))).alias("cpi_of_pc"), E.floored(E.log_pc_norm(F.col("pc"))).alias("pc_norm"), r.alias("sigma_r"), t.alias("sigma_t"), n.alias("sigma_n"))


FEATURE = {"miss": "CASE WHEN alert_id % 7 <> 0 THEN miss_km END", "radial": "CASE WHEN alert_id % 5 = 0 THEN miss_km / 3 END", "b_n": "CASE WHEN alert_id % 3 <> 0 THEN -miss_km / 2 END", "kms": "CASE WHEN alert_id % 2 = 0 THEN v_rel END", "kmh": "CASE WHEN alert_id % 6 <> 1 THEN v_rel * 3600e0 END", "age1": "CASE WHEN alert_id % 8 > 2 THEN age_h END", "age2": "CASE WHEN alert_id % 8 > 4 THEN age_h / 2 END", "both_age": "CASE WHEN alert_id % 8 = 1 THEN 12e0 END", "hbr": "CASE WHEN alert_id % 4 <> 0 THEN hbr_km END", "alt1": "CASE WHEN alert_id % 10 > 3 THEN 500e0 END", "alt2": "CASE WHEN alert_id % 10 > 6 THEN 700e0 END"}


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT alert_id, {part(FEATURE)} FROM alerts), v AS (SELECT alert_id, miss, coalesce(radial, abs(b_n)) AS radial, coalesce(kms, kmh / 3600) AS speed, greatest(coalesce(age1, both_age), coalesce(age2, both_age)) AS age_max, least(coalesce(age1, both_age), coalesce(age2, both_age)) AS age_min, coalesce(hbr, 0.01e0) AS hbr, CASE WHEN alt1 IS NOT NULL AND alt2 IS NOT NULL THEN (alt1 + alt2) / 2 ELSE coalesce(alt1, alt2) END AS altitude, hbr IS NULL AS no_hbr FROM t)
SELECT alert_id, miss, {R6.format('radial')} AS radial, {R6.format('speed')} AS speed, age_max, age_min, hbr, altitude, concat_ws(',', CASE WHEN miss IS NULL THEN 'miss' END, CASE WHEN radial IS NULL THEN 'radial' END, CASE WHEN speed IS NULL THEN 'speed' END, CASE WHEN age_max IS NULL THEN 'age' END, CASE WHEN no_hbr THEN 'hbr (default)' END, CASE WHEN altitude IS NULL THEN 'altitude' END) AS missing FROM v""")
def alert_features(spark, sf_dir):
    """The seven features with their fallbacks, and what was missing."""
    t = alerts(spark, sf_dir).selectExpr("alert_id", *[f"{e} AS {n}" for n, e in FEATURE.items()])
    ages = [F.coalesce("age1", "both_age"), F.coalesce("age2", "both_age")]
    v = t.select("alert_id", "miss", F.coalesce("radial", F.abs("b_n")).alias("radial"), F.coalesce("kms", F.col("kmh") / 3600).alias("speed"), F.greatest(*ages).alias("age_max"), F.least(*ages).alias("age_min"), F.coalesce("hbr", F.lit(0.01)).alias("hbr"), F.coalesce((F.col("alt1") + F.col("alt2")) / 2, "alt1", "alt2").alias("altitude"), F.col("hbr").isNull().alias("no_hbr"))
    gone = [F.when(F.col(c).isNull(), n) for c, n in (("miss", "miss"), ("radial", "radial"), ("speed", "speed"), ("age_max", "age"))]
    return v.select("alert_id", "miss", E.floored(F.col("radial")).alias("radial"), E.floored(F.col("speed")).alias("speed"), "age_max", "age_min", "hbr", "altitude", F.concat_ws(",", *gone, F.when(F.col("no_hbr"), "hbr (default)"), F.when(F.col("altitude").isNull(), "altitude")).alias("missing"))


RAW = {"tca_hours": "CASE WHEN alert_id % 3 = 0 THEN tca_h END", "tca_text": "CASE WHEN alert_id % 3 = 1 THEN '2024-01-0' || (1 + CAST(tca_h AS INT) // 24) || 'T0' || CAST(tca_h AS INT) % 10 || ':30:00' END", "level": "CASE WHEN alert_id % 4 = 0 THEN 'WARNING' END", "zone": "CASE WHEN alert_id % 5 = 0 THEN 42e0 END", "tag": "CASE WHEN alert_id % 7 = 0 THEN 'debris' END"}


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT alert_id, {part(RAW)} FROM alerts), h AS (SELECT *, coalesce(tca_hours, CASE WHEN tca_text IS NOT NULL THEN greatest(0, epoch(CAST(tca_text AS TIMESTAMP) - TIMESTAMP '2024-01-01 06:00:00') / 3600) END) AS h FROM t)
SELECT alert_id, floor(h * 1e4 + 0.5) / 1e4 AS tca_hours, floor(h * 6000 + 0.5) / 100 AS tca_minutes, coalesce(level, 'WATCH') AS severity, coalesce(zone, 100) AS zone_radius_km, coalesce(tag, 'screening') AS source FROM h""")
def normalised_alerts(spark, sf_dir):
    """Defaults of an alert; hours to the approach from its time where they are missing, never invented."""
    t = alerts(spark, sf_dir).selectExpr("alert_id", *[f"{e.replace('//', 'DIV')} AS {n}" for n, e in RAW.items()])
    since = (F.unix_micros(F.to_timestamp("tca_text")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01T06:00:00")))) / 3.6e9
    h = F.coalesce("tca_hours", F.when(since.isNotNull(), F.greatest(F.lit(0.0), since)))
    return t.select("alert_id", E.floored(h, 4).alias("tca_hours"), (F.floor(h * 6000 + 0.5) / 100).alias("tca_minutes"), F.coalesce("level", F.lit("WATCH")).alias("severity"), F.coalesce("zone", F.lit(100.0)).alias("zone_radius_km"), F.coalesce("tag", F.lit("screening")).alias("source"))


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT alert_id, CASE WHEN alert_id % 13 <> 0 THEN miss_km END AS km, CASE WHEN alert_id % 17 = 0 THEN NULL WHEN pc < 1e-30 THEN 0 ELSE (floor(pc * 1e9) + 1e-3) / 1e9 END AS pc, CASE WHEN alert_id % 19 <> 0 THEN tca_h * 7 - 100 END AS m FROM alerts)
SELECT alert_id, CASE WHEN km IS NULL THEN 'n/a' WHEN km < 1 THEN CAST(floor(km * 1000 + 0.5) AS BIGINT) || ' m' WHEN km < 10 THEN printf('%.2f', floor(km * 100 + 0.5) / 100) || ' km' ELSE printf('%.1f', floor(km * 10 + 0.5) / 10) || ' km' END AS distance, CASE WHEN pc IS NULL THEN 'n/a' WHEN pc = 0 THEN '0' ELSE format('{{:.1e}}', pc) END AS probability,
 CASE WHEN m IS NULL THEN 'n/a' ELSE CASE WHEN m >= 0 THEN 'T-' ELSE 'T+' END || CASE WHEN abs(m) < 90 THEN CAST(floor(abs(m) + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f', floor(abs(m) / 60 * 10 + 0.5) / 10) || ' h' END END AS countdown FROM t""")
def display_formats(spark, sf_dir):
    """Distance, probability and countdown as text (shown probabilities stand off the middle between two roundings)."""
    t = alerts(spark, sf_dir).selectExpr("alert_id", "CASE WHEN alert_id % 13 <> 0 THEN miss_km END AS km", "CASE WHEN alert_id % 17 = 0 THEN NULL WHEN pc < 1e-30 THEN 0 ELSE (floor(pc * 1e9) + 1e-3) / 1e9 END AS pc", "CASE WHEN alert_id % 19 <> 0 THEN tca_h * 7 - 100 END AS m")
    return t.select("alert_id", E.shown_distance(F.col("km")).alias("distance"), E.shown_pc(F.col("pc")).alias("probability"), E.shown_countdown(F.col("m")).alias("countdown"))


RADII = {"p90": "CASE WHEN alert_id % 4 = 0 THEN miss_km END", "r90": "CASE WHEN alert_id % 4 = 1 THEN miss_km - 1 END", "p50": "CASE WHEN alert_id % 3 = 0 THEN sigma_km END", "any_km": "CASE WHEN alert_id % 2 = 0 THEN v_rel END"}


@query(f"""WITH {ALERTS_SQL}, t AS (SELECT alert_id, {part(RADII)} FROM alerts) SELECT alert_id, CASE WHEN p90 > 0 THEN p90 WHEN r90 > 0 THEN r90 WHEN p50 > 0 THEN p50 WHEN any_km > 0 THEN any_km END AS radius_km, CASE WHEN p90 > 0 OR r90 > 0 THEN 90 WHEN p50 > 0 THEN 50 END AS percentile FROM t""")
def cloud_radius(spark, sf_dir):
    """The first positive one of a cloud's alternative radii, and which percentile it is."""
    t = alerts(spark, sf_dir).selectExpr("alert_id", *[f"{e} AS {n}" for n, e in RADII.items()])
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return t.select("alert_id", F.coalesce(*map(some, RADII)).alias("radius_km"), F.when(some("p90").isNotNull() | some("r90").isNotNull(), 90).when(some("p50").isNotNull(), 50).alias("percentile"))


@query(f"""WITH {PLANE_SQL}, v AS (SELECT alert_id, hbr_km * hbr_km / (c_tt + c_nn) AS u, (b_t * b_t + b_n * b_n) / (c_tt + c_nn) AS x FROM plane)
SELECT alert_id, {R9.format("u * exp(-u - x) * list_sum(list_transform(range(0, 30), lambda k: exp(k * ln(greatest(u * x, 1e-300)) - 2 * lgamma(k + 1))))")} AS first_term FROM v""")
def first_term_probability(spark, sf_dir):
    """The first term of the series for every alert, out of the mean variance of its plane."""
    return plane(spark, sf_dir).select("alert_id", E.floored(E.first_term_pc(*map(F.col, ("b_t", "b_n", "c_tt", "c_nn", "hbr_km"))), 9).alias("first_term"))
