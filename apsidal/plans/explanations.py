"""Explanation paragraphs of every alert's zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.derived import ALERTS_SQL, alerts
from .catalog import query

#: What the paragraphs are said about, in SQL that both engines read; shown probabilities stand off the middle between roundings.
FACTS = {
    "radius": "sigma_km * 3", "lat": "CASE WHEN alert_id % 7 <> 0 THEN (sat1 * 37 % 18000 - 9000) / 1e2 END", "lon": "(sat2 * 53 % 36000 - 18000) / 1e2", "alt": "400 + sat1 % 300", "minutes": "tca_h * 7 - 100",
    "source": "CASE WHEN alert_id % 2 = 0 THEN 'percentile_90' ELSE 'three_sigma_of_age' END", "members": "sat1 % 9", "p": "CASE WHEN pc < 1e-30 THEN 0 ELSE (floor(pc * 1e9) + 1e-3) / 1e9 END",
    "first": "CASE WHEN alert_id % 11 <> 0 THEN 'OBJECT ' || sat1 END", "second": "'OBJECT ' || sat2", "speed": "CASE WHEN alert_id % 5 <> 0 THEN v_rel END", "level": "CASE WHEN alert_id % 6 <> 0 THEN 'WATCH' END", "act": "CASE WHEN alert_id % 4 <> 0 THEN 'MONITOR' END",
    "dv": "(alert_id % 300) / 1e2", "options": "alert_id % 3", "checked": "alert_id % 2", "state": "CASE alert_id % 5 WHEN 0 THEN 'not_yet_released' WHEN 1 THEN 'outside_debris_window' WHEN 2 THEN 'released' WHEN 3 THEN 'released' END",
}
facts_sql = ", ".join(f"{e} AS {n}" for n, e in FACTS.items())
_KM = "CASE WHEN {0} IS NULL THEN 'n/a' WHEN {0} < 1 THEN CAST(floor({0} * 1000 + 0.5) AS BIGINT) || ' m' WHEN {0} < 10 THEN printf('%.2f', floor({0} * 100 + 0.5) / 100) || ' km' ELSE printf('%.1f', floor({0} * 10 + 0.5) / 10) || ' km' END"
_WHEN = "CASE WHEN minutes >= 0 THEN 'T-' ELSE 'T+' END || CASE WHEN abs(minutes) < 90 THEN CAST(floor(abs(minutes) + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f', floor(abs(minutes) / 60 * 10 + 0.5) / 10) || ' h' END"
_PC = "CASE WHEN p = 0 THEN '0' ELSE format('{:.1e}', p) END"
_TWO = "printf('%.2f', floor(({}) * 100 + 0.5) / 100)"


def facts(spark, sf_dir):
    return alerts(spark, sf_dir).selectExpr("alert_id", "miss_km", "sat1", *[f"{e} AS {n}" for n, e in FACTS.items()])


@query(f"""WITH {ALERTS_SQL}, f AS (SELECT alert_id, miss_km, {facts_sql} FROM alerts)
SELECT alert_id, 'A sphere of radius ' || {_KM.format('radius')} || ' centred at ' || CASE WHEN lat IS NULL THEN 'an unresolved location' ELSE {_TWO.format('abs(lat)')} || '°' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || {_TWO.format('abs(lon)')} || '°' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || ', ' || alt || ' km up' END || ' at ' || {_WHEN} || '. The radius comes from ' || replace(source, '_', ' ') || '; ' || members || ' tracked object(s) are inside it at that instant.' AS area,
CASE WHEN first IS NULL THEN 'No conjunction inside this zone has a computed closest approach.' ELSE first || ' and ' || second || ' pass ' || {_KM.format('miss_km')} || ' apart ' || CASE WHEN speed IS NULL THEN '' ELSE 'at ' || printf('%.1f', floor(speed * 10 + 0.5) / 10) || ' km/s ' END || '(' || {_WHEN} || '). Collision probability (Foster) ' || {_PC} || CASE WHEN alert_id % 2 = 0 THEN ', Chan ' || {_PC} ELSE '' END || CASE WHEN alert_id % 3 = 0 THEN ', worst-case (Alfano) ' || {_PC} ELSE '' END || '; severity ' || coalesce(level, 'n/a') || coalesce(', decision ' || act, '') || '.' END AS closest_approach FROM f""")
def zone_explanations(spark, sf_dir):
    """Where each zone is and how near its pair comes, in words."""
    c, f = F.col, facts(spark, sf_dir)
    area = T.area(*map(c, ("radius", "lat", "lon", "alt", "minutes", "source", "members")))
    near = T.closest(c("first"), c("second"), c("miss_km"), c("speed"), c("minutes"), c("p"), F.when(c("alert_id") % 2 == 0, c("p")), F.when(c("alert_id") % 3 == 0, c("p")), c("level"), c("act"))
    return f.select("alert_id", area.alias("area"), near.alias("closest_approach"))


_BURN = f"""'m' || sat1 || ': along_plus (' || {_TWO.format('dv')} || ' m/s) moves the miss to ' || {_KM.format('miss_km')} || ' and Pc to ' || {_PC} || ', ' || CASE alert_id % 3 WHEN 0 THEN 'cascade-safe' WHEN 1 THEN 'NOT cascade-safe' ELSE 'cascade check: not run' END || '; engine ' || CASE WHEN alert_id % 2 = 0 THEN 'Hall' ELSE 'n/a' END"""


@query(f"""WITH {ALERTS_SQL}, f AS (SELECT alert_id, miss_km, sat1, {facts_sql} FROM alerts)
SELECT alert_id, CASE alert_id % 4 WHEN 0 THEN 'No operational payload in this zone can manoeuvre (debris / rocket bodies only).' WHEN 1 THEN 'No burn was planned: m' || sat1 || ' (no safe burn); n (out of fuel).' ELSE 'Re-propagated avoidance burns — ' || {_BURN} || CASE WHEN alert_id % 4 = 3 THEN '; ' || {_BURN} ELSE '' END || '. Cryogenic LOX/LH2 has the best Isp but boils off, so it is listed for comparison only.' END AS avoidance,
CASE WHEN options = 0 THEN 'No burn is proposed here, so nobody else''s risk changes. ' WHEN checked > 0 THEN 'Each option was re-screened for 24 h against the catalogue and live fragments: ' || members || ' new or worsened close approach(es) found, ' || options || ' option(s) unsafe. ' ELSE 'The 24 h secondary screening has not run for these options (time budget), so effects on others are unknown. ' END || members || ' object(s) are downstream of this zone in the cascade graph.' AS effect_on_others,
CASE WHEN state IS NULL THEN 'No breakup has been simulated yet. ' || CASE WHEN members > 0 THEN 'If this pair collided, the NASA breakup model predicts ~' || members || ' fragments ≥10 cm (' || CASE WHEN options > 0 THEN '' ELSE 'non-' END || 'catastrophic).' ELSE 'Run the debris simulation to see the fragment cloud.' END
 ELSE 'Debris layer: ' || CASE WHEN state = 'not_yet_released' THEN 'event 4 has not broken up yet at this time' WHEN state = 'outside_debris_window' THEN 'this TCA is beyond the 6 h debris look-ahead, so fragments of event 4 were not propagated that far' WHEN alert_id % 5 = 2 THEN 'this is the breakup point of event 4: ~' || members || ' fragments ≥10 cm are released here (30 min later the cloud''s 90 % radius is ' || {_KM.format('radius')} || ')' WHEN members > 0 THEN '~' || members || ' fragment(s) of event 4 are inside the zone (nearest ' || {_KM.format('miss_km')} || ')' ELSE 'no fragment of event 4 is inside the zone at TCA (nearest ' || {_KM.format('miss_km')} || ')' END || '.' END AS debris FROM f""")
def effect_explanations(spark, sf_dir):
    """What each zone's debris is, which burns avoid it, and what they do to others, in words."""
    c, f = F.col, facts(spark, sf_dir)
    k = c("alert_id")
    mover = lambda name, planned, status: F.struct(name.alias("name"), F.lit(status).alias("status"), F.lit("along_plus" if planned else None).cast("string").alias("candidate"), c("dv").alias("dv_ms"), c("miss_km"), c("p").alias("pc"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("safe"), F.lit(None).cast("string").alias("check"), F.when(k % 2 == 0, "Hall").alias("engine"))
    own = F.concat(F.lit("m"), c("sat1").cast("string"))
    burn, idle, dry = mover(own, True, "planned"), mover(own, False, "no_safe_burn"), mover(F.lit("n"), False, "out_of_fuel")
    movers = F.when(k % 4 == 1, F.array(idle, dry)).when(k % 4 == 2, F.array(burn, dry)).when(k % 4 == 3, F.array(burn, burn)).otherwise(F.filter(F.array(dry), lambda _: F.lit(False)))
    later = F.array(F.struct(F.lit(30.0).alias("minutes"), c("radius").alias("p90_km")), F.struct(F.lit(60.0).alias("minutes"), F.lit(None).cast("double").alias("p90_km")))
    event = F.struct(F.lit(4).alias("event_id"), "state", F.lit(6.0).alias("window_h"), (k % 5 == 2).alias("own"), F.lit(0.5).alias("t_rel_s"), c("members").alias("fragments"), c("members").alias("inside"), c("miss_km").alias("nearest_km"), later.alias("later"))
    return f.select("alert_id", T.avoidance(movers).alias("avoidance"), T.effect(c("options"), c("checked"), c("members"), c("options"), c("members")).alias("effect_on_others"), T.debris(F.when(c("state").isNotNull(), F.array(event)), c("members"), c("options") > 0).alias("debris"))
