"""Catalogue, encounters, decisions and telemetry derived from the test tables by integer-seeded formulas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encounters import MU_KM3_S2, isotropic_pc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a_km, inc, raan, phase of circular orbits, one per supplier.

    Two neighbours share their node and pass it together, up to three kilometres apart in height, so every
    scale has encounters; slightly different periods take most of them out of reach after some orbits.
    """
    k, g = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 2)
    deg = lambda c: c * F.lit(math.pi / 180)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (6778.137 + g * 37 % 400 + k % 2 * (g % 7) * 0.5).alias("a_km"), deg(30 + k * 53 % 60).alias("inc"), deg(g * 71 % 360).alias("raan"), deg(g * 29 % 360).alias("phase"))


def grid(objs: DataFrame, steps: int, step_s: float = 60.0, keep: list[str] | None = None) -> DataFrame:
    """Positions and velocities of every object on a time grid: id, k, x, y, z, vx, vy, vz."""
    return states_at(objs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))), step_s, keep)


def grid_by_step(objs: DataFrame, steps: int, step_s: float = 60.0, most: int = 200_000, states: int = 1_000_000, keep: list[str] | None = None, block: int = 1) -> DataFrame:
    """The same grid, dealt by step without moving any state: the steps are dealt and the catalogue, once counted, is broadcast.

    A partition holds about ``states`` states, or one step. With ``block``, steps that follow each other are dealt together: the
    column block says which, and a pair that stays near is combined over them before it moves.
    """
    spark, n = objs.sparkSession, objs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # a number, or the few bytes of the steps are coalesced
    parts = max(parts, min(steps, n * steps // states))
    if block > 1:
        at = F.floor(F.col("k") / block).cast("int").alias("block")
        if n > most:
            return grid(objs, steps, step_s, keep).select("*", at).repartition(parts, "block")
        dealt = spark.range(steps).select(F.col("id").cast("int").alias("k")).select("k", at).repartition(parts, "block")
        return states_at(dealt.crossJoin(F.broadcast(objs)), step_s, [*(keep or []), "block"])
    if n > most:
        return grid(objs, steps, step_s, keep).repartition(parts, "k")
    return states_at(spark.range(steps).select(F.col("id").cast("int").alias("k")).repartition(parts, "k").crossJoin(F.broadcast(objs)), step_s, keep)


def states_at(rows: DataFrame, step_s: float, keep: list[str] | None = None) -> DataFrame:
    """States of circular orbits at step k of each row, with the columns to keep."""
    keep = keep or []
    g = rows.withColumn("n", F.sqrt(MU_KM3_S2 / (F.col("a_km") * F.col("a_km") * F.col("a_km"))))
    u = F.col("phase") + F.col("n") * F.col("k") * step_s
    g = g.select(*keep, "id", "k", "a_km", "n", F.cos(u).alias("cu"), F.sin(u).alias("su"), F.cos("raan").alias("co"), F.sin("raan").alias("so"), F.cos("inc").alias("ci"), F.sin("inc").alias("si"))
    c = F.col
    at = lambda p, q: (c("co") * p - c("so") * c("ci") * q, c("so") * p + c("co") * c("ci") * q, c("si") * q)
    r, v = at(c("cu"), c("su")), at(-c("su"), c("cu"))
    return g.select(*keep, "id", "k", *[(c("a_km") * e).alias(n) for e, n in zip(r, "xyz", strict=True)], *[(c("a_km") * c("n") * e).alias(f"v{n}") for e, n in zip(v, "xyz", strict=True)])


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alert_id, sat1 < sat2, miss_km, v_rel, age_h, tca_h, sigma_km, hbr_km, pc: one per line item, its endpoints two full keys."""
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_suppkey"), F.col("l_partkey")
    seed = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729
    out = li.where(a != b).select(
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("alert_id"),
        F.least(a, b).alias("sat1"),
        F.greatest(a, b).alias("sat2"),
        ((seed % 30000) / 1000.0).alias("miss_km"),
        (F.col("l_quantity") * 0.3).alias("v_rel"),
        (F.col("l_partkey") % 168).cast("double").alias("age_h"),
        ((F.col("l_suppkey") * 13 + F.col("l_orderkey")) % 72).cast("double").alias("tca_h"),
        (0.5 + (F.col("l_partkey") % 40) / 10.0).alias("sigma_km"),
        F.lit(0.02).alias("hbr_km"),
    )
    return out.withColumn("pc", isotropic_pc(F.col("miss_km"), F.col("sigma_km"), F.col("hbr_km")))


def _pc_sql(terms: int = 12) -> str:
    lam, x = "(miss_km * miss_km / (sigma_km * sigma_km * 2))", "(hbr_km * hbr_km / (sigma_km * sigma_km * 2))"
    rows = [f"power({lam}, {j}) / {math.factorial(j)}e0 * ({' + '.join(f'power({x}, {i}) / {math.factorial(i)}e0' for i in range(j + 1, j + 1 + terms))})" for j in range(terms)]
    return f"greatest(0.0, least(1.0, exp(-{lam} - {x}) * ({' + '.join(rows)})))"


#: The same relations for the oracle.
OBJECTS_SQL = "objects AS (SELECT s_suppkey AS id, 6778.137 + s_suppkey // 2 * 37 % 400 + s_suppkey % 2 * (s_suppkey // 2 % 7) * 0.5 AS a_km, radians(30 + s_suppkey * 53 % 60) AS inc, radians(s_suppkey // 2 * 71 % 360) AS raan, radians(s_suppkey // 2 * 29 % 360) AS phase FROM supplier)"
GRID_SQL = """steps AS (SELECT unnest(range(0, {steps})) AS k),
angles AS (SELECT id, k, a_km, sqrt(398600.8 / (a_km * a_km * a_km)) AS n, phase + sqrt(398600.8 / (a_km * a_km * a_km)) * k * 60.0 AS u, raan, inc FROM objects, steps),
grid AS (SELECT id, k, a_km * (cos(raan) * cos(u) - sin(raan) * cos(inc) * sin(u)) AS x, a_km * (sin(raan) * cos(u) + cos(raan) * cos(inc) * sin(u)) AS y, a_km * sin(inc) * sin(u) AS z,
 a_km * n * (-cos(raan) * sin(u) - sin(raan) * cos(inc) * cos(u)) AS vx, a_km * n * (-sin(raan) * sin(u) + cos(raan) * cos(inc) * cos(u)) AS vy, a_km * n * sin(inc) * cos(u) AS vz FROM angles)"""
ALERTS_SQL = f"""raw AS (SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS alert_id, least(l_suppkey, l_partkey) AS sat1, greatest(l_suppkey, l_partkey) AS sat2,
 ((l_orderkey * 7919 + l_linenumber * 104729) % 30000) / 1000.0 AS miss_km, l_quantity * 0.3 AS v_rel, CAST(l_partkey % 168 AS DOUBLE) AS age_h,
 CAST((l_suppkey * 13 + l_orderkey) % 72 AS DOUBLE) AS tca_h, 0.5 + (l_partkey % 40) / 10.0 AS sigma_km, CAST(0.02 AS DOUBLE) AS hbr_km FROM lineitem WHERE l_suppkey <> l_partkey),
alerts AS (SELECT *, {_pc_sql()} AS pc FROM raw)"""

#: Catalogue records of the parts, in SQL that both engines read.
CATALOGUE = {
    "id": "p_partkey",
    "name": "CASE p_partkey % 14 WHEN 0 THEN 'COSMOS ' || p_partkey || ' DEB' WHEN 1 THEN 'STARLINK-' || p_partkey WHEN 2 THEN 'SL-' || p_partkey || ' R/B' WHEN 3 THEN 'ISS (ZARYA)' WHEN 4 THEN 'OBJECT ' || p_partkey WHEN 5 THEN 'GOES ' || p_partkey WHEN 6 THEN 'TBA - ' || p_partkey WHEN 7 THEN 'GSAT-' || p_partkey WHEN 8 THEN 'FENGYUN AKM' WHEN 9 THEN 'IRIDIUM ' || p_partkey WHEN 10 THEN 'FRAGMENT ' || p_partkey WHEN 11 THEN 'TITAN (DEBRIS)' WHEN 12 THEN '' END",
    "owner": "CASE p_size % 15 WHEN 0 THEN 'US' WHEN 1 THEN 'CIS' WHEN 2 THEN 'PRC' WHEN 3 THEN 'UK' WHEN 4 THEN 'ISS' WHEN 5 THEN 'TBD' WHEN 6 THEN 'XYZ' WHEN 7 THEN 'GER' WHEN 8 THEN 'ORB' WHEN 9 THEN 'SKOR' WHEN 10 THEN 'ARGN' WHEN 11 THEN 'USBZ' WHEN 12 THEN 'NICO' WHEN 13 THEN '' END",
    "rcs_m2": "CASE WHEN p_size % 5 <> 0 THEN p_size / 25e0 * CASE WHEN p_partkey % 3 = 0 THEN 1e-1 ELSE 1e0 END END",
    "launch_year": "1957 + p_partkey % 70",
    "listed_type": "CASE p_partkey % 5 WHEN 0 THEN 'PAYLOAD' WHEN 1 THEN 'ROCKET BODY' WHEN 2 THEN 'DEB' WHEN 3 THEN 'TBA' END",
    "scenario_mass": "CASE WHEN p_partkey % 11 = 0 THEN 900e0 + p_size END",
    "tail": "lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')",
}
CATALOGUE_SQL = "catalogue AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CATALOGUE.items()) + " FROM part)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in CATALOGUE.items()])
