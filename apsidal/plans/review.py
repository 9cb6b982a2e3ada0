"""Queries of the advisory rankers: features of the nodes, rule-of-thumb burns, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.encounters import MU_KM3_S2, cpi_of_pc, floored
from ..operators import review as R
from ..operators.graph import checkpoint
from ..sources.derived import ALERTS_SQL, alerts
from .catalog import R6, query

#: State of a satellite, in SQL that both engines read.
STATE = {"r_km": "6778.137e0 + node * 37 % 1500", "agency": "CAST(1 + node % 9 AS DOUBLE)"}
_CPI = "CASE WHEN pc <= 0 THEN 0 ELSE greatest(0, least(10, 2 * (log10(pc) + 9))) END"
FEATURES_SQL = f"""{ALERTS_SQL}, sides AS (SELECT unnest([sat1, sat2]) AS node, *, {_CPI} AS cpi, 0.45 * pc + 0.25 * exp(-miss_km / 120e0) + 0.15 * least(v_rel * 3600 / 18000e0, 1) + 0.15 * exp(-tca_h * 60 / 180e0) AS w FROM alerts),
by_node AS (SELECT node, 2 * count(*) AS ends, 1.75 * sum(w) AS influence, avg(pc) AS mean_pc, avg(1 / (1 + miss_km)) AS mean_nearness, avg(tca_h * 60) / 180e0 AS mean_time, avg(v_rel * 3600) / 20000e0 AS mean_speed, max(cpi) / 10 AS peak, 1 - exp(sum(ln(1 - least(pc, 1 - 1e-15)))) AS hit FROM sides GROUP BY node),
states AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in STATE.items())} FROM by_node),
features AS (SELECT node, r_km / 1e4 AS position, sqrt({MU_KM3_S2} / r_km) / 3e4 AS speed, (r_km - 6371e0) / 2e3 AS altitude, agency / 10 AS agency, peak, ends / greatest(count(*) OVER () - 1, 1) AS degree, mean_pc, mean_nearness, mean_time, influence, mean_speed, floor(hit * 1e6 + 0.5) / 1e6 AS hit FROM states)"""
NAMES = ("position", "speed", "altitude", "agency", "peak", "degree", "mean_pc", "mean_nearness", "mean_time", "influence", "mean_speed")


def features(spark, sf_dir):
    """Features of all satellites of all alerts, and the probability that one is hit."""
    a = alerts(spark, sf_dir)
    ends = a.select(F.explode(F.array("sat1", "sat2")).alias("node"), "pc")
    hit = ends.groupBy("node").agg(F.max(cpi_of_pc(F.col("pc"))).alias("peak_index"), (1 - F.exp(F.sum(F.log(1 - F.least("pc", F.lit(1 - 1e-15)))))).alias("hit"))
    nodes = checkpoint(hit.selectExpr("*", *[f"{e} AS {n}" for n, e in STATE.items()]).withColumns({"v_kms": F.sqrt(MU_KM3_S2 / F.col("r_km")), "altitude_km": F.col("r_km") - 6371.0}))
    edges = a.select(F.col("sat1").alias("a"), F.col("sat2").alias("b"), "pc", "miss_km", (F.col("v_rel") * 3600).alias("speed_kmh"), (F.col("tca_h") * 60).alias("tca_min"))
    return R.summary_features(nodes.drop("hit"), edges).join(nodes.select("node", floored(F.col("hit")).alias("hit")), "node")


@query(f"WITH {FEATURES_SQL} SELECT node, {', '.join(f'{R6.format(n)} AS {n}' for n in NAMES)} FROM features")
def ranker_features(spark, sf_dir):
    """The eleven inputs of the advisory rankers for every satellite."""
    return features(spark, sf_dir).select("node", *[floored(F.col(n)).alias(n) for n in NAMES])


@query(f"""WITH {FEATURES_SQL} SELECT node, CAST(greatest(least(ceil(hit * 4 + influence * 1.5), 4), 0) AS INT) AS depth, {R6.format("greatest(least((peak - 0.5) * 0.25, 1), -1)")} AS radial_ms, {R6.format("greatest(least(0.05 + hit * 1.35 + peak / 12 + greatest(least(speed, 1), 0) * 0.2, 5), 0.05)")} AS along_ms, {R6.format("greatest(least((influence - 0.35) * 0.22, 1), -1)")} AS across_ms FROM features""")
def burn_geometry(spark, sf_dir):
    """Depth and burn of every satellite by rule of thumb, the probability of a hit in the ranker's place."""
    g = R.burn_geometry(features(spark, sf_dir), "hit")
    return g.select("node", "depth", *[floored(F.col(n)).alias(n) for n in ("radial_ms", "along_ms", "across_ms")])


#: Stand-ins for the probabilities of two trained rankers, which are inputs here: by the worst index and by the nearness.
SCORES = {"primary": "floor(peak * 1e4 + 0.5) / 1e4", "cross_check": "CASE WHEN node % 8 <> 0 THEN floor(least(1e0, mean_nearness * 3 + node % 5 / 1e1) * 1e4 + 0.5) / 1e4 END", "physics": "hit"}


@query(f"""WITH {FEATURES_SQL}, s AS (SELECT node, {', '.join(f'{e} AS {n}' for n, e in SCORES.items())} FROM features), d AS (SELECT node, abs(primary - cross_check) AS apart FROM (SELECT node, "primary", cross_check FROM s)),
r AS (SELECT rank() OVER (ORDER BY "primary") + (count(*) OVER (PARTITION BY "primary") - 1) / 2e0 AS x, rank() OVER (ORDER BY physics) + (count(*) OVER (PARTITION BY physics) - 1) / 2e0 AS y FROM s)
SELECT true AS primary_ok, true AS cross_check_ok, false AS fallback_used, (SELECT count(*) FROM d WHERE apart > 0.25) AS disagreement_count, (SELECT floor(max(apart) * 1e4 + 0.5) / 1e4 FROM d) AS max_disagreement, (SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT node FROM d WHERE apart > 0.25 ORDER BY node LIMIT 20)) AS disputed, (SELECT floor(corr(x, y) * 1e4 + 0.5) / 1e4 FROM r) AS spearman_vs_physics""".replace("abs(primary", 'abs("primary"').replace("AS primary,", 'AS "primary",'))
def ranker_review(spark, sf_dir):
    """Agreement of two rankers over all satellites, and with the probability of a hit."""
    return R.ranker_review(checkpoint(features(spark, sf_dir).selectExpr("node", *[f"{e} AS `{n}`" for n, e in SCORES.items()])))
