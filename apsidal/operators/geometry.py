"""Encounter covariances from two objects' states, and the shape of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.encounters import age_sigmas
from .graph import checkpoint
from .statistics import histogram_quantiles

#: Slowest relative speed (km/s) of a short encounter; deviations of the ellipse that is shown.
SHORT_KMS, ELLIPSE_LEVEL = 0.1, 3


def encounter_covariance(pairs: DataFrame, age1_days: Column, age2_days: Column) -> DataFrame:
    """Add b_t, b_n, c_tt, c_tn, c_nn, speed, short_encounter, a_m, b_m, angle to pairs of states (x1..vz1, x2..vz2).

    Each object's covariance grows with the age of its elements along its own radial, along-track and
    cross-track axes. Both are turned into the common frame, added, and projected on the plane across the
    relative velocity; the ellipse is three deviations of the projected covariance, in metres.
    """
    state = lambda n, s: V.packed([F.col(f"{n}{c}{s}") for c in "xyz"])
    rows = pairs.withColumns({f"__{n or 'r'}{s}": state(n, s) for s in "12" for n in ("", "v")})
    r1, v1, r2, v2 = (V.unpacked(f"__{n}{s}") for s in "12" for n in ("r", "v"))
    rows = rows.withColumns({f"__{a}{s}": V.packed(x) for s, r, v in (("1", r1, v1), ("2", r2, v2)) for a, x in zip("abc", V.orbit_axes(r, v), strict=True)})
    t, n, speed = V.encounter_plane(r1, v1, r2, v2)
    covariance = [V.turned_variances(tuple(V.unpacked(f"__{a}{s}") for a in "abc"), [x * x for x in age_sigmas(age)]) for s, age in (("1", age1_days), ("2", age2_days))]
    rows = rows.withColumns({"__t": V.packed(t), "speed": speed, "__m": F.array(*[x + y for x, y in zip(*covariance, strict=True)])})
    rows = rows.withColumn("__n", V.packed(V.cross(V.unpacked("__t"), [F.when(F.col("speed") > 1e-9, x / F.col("speed")).otherwise(float(i == 0)) for i, x in enumerate(V.plus(v2, v1, -1))])))
    t, n, m = V.unpacked("__t"), V.unpacked("__n"), [F.get("__m", F.lit(i)) for i in range(6)]
    apart = V.plus(r2, r1, -1)
    rows = rows.withColumns({"b_t": V.dot(t, apart), "b_n": V.dot(n, apart), "c_tt": V.form(m, t, t), "c_tn": V.form(m, t, n), "c_nn": V.form(m, n, n), "short_encounter": F.col("speed") >= SHORT_KMS})
    large, small, angle = V.principal_axes_2d(F.col("c_tt"), F.col("c_tn"), F.col("c_nn"))
    rows = rows.withColumns({"a_m": 1000 * ELLIPSE_LEVEL * F.sqrt(large), "b_m": 1000 * ELLIPSE_LEVEL * F.sqrt(small), "angle": angle})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def along_track_spread(points: DataFrame, keys: list[str], shares: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """keys, n, spread_km: the arc between two quantiles of the in-plane angle of each cloud of points (x, y, z, id).

    The plane is the best-fit one through the Earth's centre: its normal is the axis of the smallest second
    moment, out of six sums a cloud. Angles count from the centroid's direction in the plane; where the
    centroid stands on the normal, from the point of the smallest id. Clouds of fewer than three points
    have no spread. Nothing of a cloud is gathered: sums, a join back, and quantiles by histogram.
    """
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        *[F.sum(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")],
        F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("mean_r"),
        F.min_by(F.array("x", "y", "z"), "id").alias("first"),
    ).where("n >= 3")
    sums = V.with_least_axis(sums, [F.col(f"m{a}") for a in ("xx", "xy", "xz", "yy", "yz", "zz")], "h")
    h, c, one = V.unpacked("h"), [F.col(f"c{a}") for a in "xyz"], V.unpacked("first")
    in_plane = lambda p: V.plus(p, V.scaled(h, V.dot(p, h)), -1)
    sums = sums.withColumns({"own": V.packed(in_plane(c)), "other": V.packed(in_plane(one))})
    own, other = V.unpacked("own"), V.unpacked("other")
    weak = V.size(own) < 1e-6 * F.greatest(V.size(c), F.lit(1.0))
    sums = sums.withColumn("e1", V.packed(V.unit([F.when(weak, y).otherwise(x) for x, y in zip(own, other, strict=True)])))
    sums = checkpoint(sums.withColumn("e2", V.packed(V.cross(h, V.unpacked("e1")))).select(*keys, "n", "mean_r", "e1", "e2"))
    p = [F.col(a) for a in "xyz"]
    theta = points.join(sums, keys).select(*keys, F.atan2(V.dot(p, V.unpacked("e2")), V.dot(p, V.unpacked("e1"))).alias("theta"))
    q = histogram_quantiles(theta, keys, "theta", list(shares))
    return q.drop("n").join(sums, keys).select(*keys, "n", (F.least(F.col("q1") - F.col("q0"), F.lit(6.283185307179586)) * F.col("mean_r")).alias("spread_km"))
