"""Advisory rankers over the alert graph: node features, agreement with physics and with each other, rule-of-thumb burns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encounters import floored
from .statistics import pair_correlations

# Weights and scales of attention.
W_PC, W_MISS, W_SPEED, W_TIME = 0.45, 0.25, 0.15, 0.15
MISS_KM, SPEED_KMH, TIME_MIN, SENT = 120.0, 18000.0, 180.0, 0.75
# Scales of the features.
POSITION_KM, SPEED_KMS, ALTITUDE_KM, TEN, MEAN_KMH = 10000.0, 30000.0, 2000.0, 10.0, 20000.0
#: Rankers whose probabilities lie further apart than this disagree on a node.
DISAGREEMENT = 0.25


def attention(pc: Column, miss_km: Column, speed_kmh: Column, tca_min: Column) -> Column:
    """Weight of one edge: likely, near, fast and early encounters weigh more; at most one."""
    return W_PC * pc + W_MISS * F.exp(-miss_km / MISS_KM) + W_SPEED * F.least(speed_kmh / SPEED_KMH, F.lit(1.0)) + W_TIME * F.exp(-F.greatest(tca_min, F.lit(0.0)) / TIME_MIN)


def summary_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eleven features of every node, by node.

    nodes: node, r_km, v_kms, altitude_km, agency, peak_index. edges: a, b, pc, miss_km, speed_kmh, tca_min,
    each counted in both directions. An edge with an unknown end, or with a null, does not count; a node
    without edges has zeros. Sums are taken by node before they meet the nodes, so busy nodes are not joined.
    """
    known = nodes.select("node").distinct()
    e = edges.where("pc IS NOT NULL AND miss_km IS NOT NULL AND speed_kmh IS NOT NULL AND tca_min IS NOT NULL")
    for end in ("a", "b"):
        e = e.join(known.withColumnRenamed("node", end), end, "left_semi")
    sides = e.withColumn("w", attention(*map(F.col, ("pc", "miss_km", "speed_kmh", "tca_min")))).withColumn("node", F.explode(F.array("a", "b")))
    by = sides.groupBy("node").agg(
        (2 * F.count(F.lit(1))).alias("ends"),
        ((1 + SENT) * F.sum("w")).alias("influence"),
        F.avg("pc").alias("mean_pc"),
        F.avg(1 / (1 + F.col("miss_km"))).alias("mean_nearness"),
        (F.avg("tca_min") / TIME_MIN).alias("mean_time"),
        (F.avg("speed_kmh") / MEAN_KMH).alias("mean_speed"),
    )
    total = F.broadcast(nodes.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("others")))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    met = nodes.join(by, "node", "left").crossJoin(total)
    scaled = [(F.col(c) / s).alias(n) for n, c, s in (("position", "r_km", POSITION_KM), ("speed", "v_kms", SPEED_KMS), ("altitude", "altitude_km", ALTITUDE_KM), ("agency", "agency", TEN), ("peak", "peak_index", TEN))]
    return met.select("node", *scaled, (F.coalesce("ends", F.lit(0)) / F.col("others")).alias("degree"), *[zero(c).alias(c) for c in ("mean_pc", "mean_nearness", "mean_time", "influence", "mean_speed")])


def burn_geometry(features: DataFrame, probability: str = "probability") -> DataFrame:
    """node, depth and a burn (radial, along, across; m/s) by rule of thumb out of features and a probability.

    Not physics: a display aid beside the searched depth and the searched burns. A null probability gives nulls.
    """
    p, risk, reach = F.col(probability), F.col("peak"), F.col("influence")
    held = lambda x, low, high: F.greatest(F.least(x, F.lit(high)), F.lit(low))
    known = lambda x: F.when(p.isNotNull(), x)
    along = held(0.05 + p * 1.35 + risk / 12.0 + held(F.col("speed"), 0.0, 1.0) * 0.2, 0.05, 5.0)
    return features.select(
        "node",
        known(held(F.ceil(p * 4.0 + reach * 1.5).cast("double"), 0.0, 4.0)).cast("int").alias("depth"),
        known(held((risk - 0.5) * 0.25, -1.0, 1.0)).alias("radial_ms"),
        known(along).alias("along_ms"),
        known(held((reach - 0.35) * 0.22, -1.0, 1.0)).alias("across_ms"),
    )


def ranker_review(scores: DataFrame, threshold: float = DISAGREEMENT, listed: int = 20) -> DataFrame:
    """One row: do two rankers (primary, cross_check) agree by node, and does the leading one rank as physics does?

    scores: node, primary, cross_check, physics; a ranker that gives no node a score is absent, and the other
    leads (fallback_used). Nodes count as disputed above the threshold; the first ``listed`` by node are
    named (the list is the feature), all are counted. Spearman needs three nodes and the leading score.
    """
    s = scores.select("node", *[F.col(c).cast("double").alias(c) for c in ("primary", "cross_check", "physics")])
    apart = F.abs(F.col("primary") - F.col("cross_check"))
    has = s.agg(F.count("primary").alias("p"), F.count("cross_check").alias("c"), F.count_if(apart > threshold).alias("disagreement_count"), floored(F.max(apart), 4).alias("max_disagreement"))
    named = s.where(apart > threshold).orderBy("node").limit(listed).agg(F.concat_ws(",", F.sort_array(F.collect_list("node"))).alias("disputed"))
    p, c = s.agg(F.count("primary"), F.count("cross_check")).first()
    lead = "primary" if p or not c else "cross_check"
    rho = pair_correlations(s.select(F.col(lead).alias("lead"), F.coalesce("physics", F.lit(0.0)).alias("physics")), ["lead", "physics"]).select(F.col("spearman").alias("spearman_vs_physics"))
    one = has.crossJoin(F.broadcast(named)).join(F.broadcast(rho), F.lit(True), "left")  # one row each
    flags = {"primary_ok": F.col("p") > 0, "cross_check_ok": F.col("c") > 0, "fallback_used": (F.col("p") == 0) & (F.col("c") > 0)}
    return one.select(*[e.alias(n) for n, e in flags.items()], "disagreement_count", F.coalesce("max_disagreement", F.lit(0.0)).alias("max_disagreement"), "disputed", "spearman_vs_physics")
