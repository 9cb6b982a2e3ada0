"""Queries over states: frames, ground points, elements, sunlight, interpolation, time grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import frames as R
from ..functions.encounters import floored
from ..operators.manoeuvres import dealt
from ..operators.screening import _settled
from ..operators.spatial import radii
from ..sources.derived import GRID_SQL, OBJECTS_SQL, grid, objects, table
from .catalog import R6, query

STEPS = 61
EPOCH_US = 1704067200000000
STATES_SQL = f"{OBJECTS_SQL}, {GRID_SQL.format(steps=STEPS)}, states AS (SELECT *, {EPOCH_US} + k * 60000000 AS us, ({EPOCH_US} + k * 60000000 - 946728000000000) / 86400e6 AS d FROM grid), angle AS (SELECT *, radians(((280.46061837 + 360.98564736629 * d + 0.000387933 * (d / 36525) * (d / 36525) - (d / 36525) * (d / 36525) * (d / 36525) / 38710000) % 360 + 360) % 360) AS th FROM states), fixed AS (SELECT *, cos(th) * x + sin(th) * y AS fx, cos(th) * y - sin(th) * x AS fy, z AS fz FROM angle)"
R3 = "floor(({}) * 1e3 + 0.5) / 1e3"


def states(spark, sf_dir):
    """States and their columns. The objects are dealt before their steps are laid out, as a catalogue of one file is one task; states are computed once."""
    g = _settled(grid(dealt(objects(spark, sf_dir), "id"), STEPS)).withColumn("us", F.lit(EPOCH_US) + F.col("k").cast("long") * 60000000)
    return g, [F.col(c) for c in "xyz"], [F.col(c) for c in ("vx", "vy", "vz")]


def _with_elements(g, r, v):
    """The states with the parts of their elements as columns, and the elements out of these."""
    parts = R.element_parts(r, v)
    return _settled(g.withColumns(parts)), R.elements(r, v, {n: F.col(n) for n in parts})


@query(f"WITH {STATES_SQL} SELECT id, k, floor(sqrt(vx*vx + vy*vy + vz*vz) * 3600 * 100 + 0.5) / 100 AS speed_kmh, floor((sqrt(x*x + y*y + z*z) - 6371) * 100 + 0.5) / 100 AS altitude_km FROM states")
def snapshot_rows(spark, sf_dir):
    """Speed and height of every object at every step."""
    g, r, v = states(spark, sf_dir)
    return g.select("id", "k", floored(R.norm(v) * 3600, 2).alias("speed_kmh"), floored(R.norm(r) - 6371, 2).alias("altitude_km"))


@query(f"""WITH {STATES_SQL} SELECT id, k, {R6.format('th')} AS gmst, {R3.format('fx')} AS fx, {R3.format('fy')} AS fy, floor(degrees(atan2(fz, sqrt(fx*fx + fy*fy))) * 1e4 + 0.5) / 1e4 AS lat, floor(degrees(atan2(fy, fx)) * 1e4 + 0.5) / 1e4 AS lon, {R3.format('greatest(0, sqrt(fx*fx + fy*fy + fz*fz) - 6378.137)')} AS height_km FROM fixed""")
def ground_track(spark, sf_dir):
    """Sidereal angle, Earth-fixed position and ground point."""
    g, r, _ = states(spark, sf_dir)
    th = R.gmst(F.col("us"))
    fixed = R.turned(r, th)
    lat, lon, height = R.ground_point(fixed)
    return g.select("id", "k", floored(th).alias("gmst"), floored(fixed[0], 3).alias("fx"), floored(fixed[1], 3).alias("fy"), floored(lat, 4).alias("lat"), floored(lon, 4).alias("lon"), floored(height, 3).alias("height_km"))


E2 = "(1 / 298.257223563 * (2 - 1 / 298.257223563))"
_LAT = f"atan2(fz, sqrt(fx*fx + fy*fy) * (1 - {E2}))"
_ROUNDS = "".join(f", l{i} AS (SELECT *, atan2(fz + {E2} * 6378.137 / sqrt(1 - {E2} * sin(p{i}) * sin(p{i})) * sin(p{i}), sqrt(fx*fx + fy*fy)) AS p{i + 1} FROM {'l0' if i == 0 else f'l{i - 1}'}{'_' if i == 0 else ''})" for i in range(10))


@query(f"""WITH {STATES_SQL}, l0_ AS (SELECT *, {_LAT} AS p0 FROM fixed){_ROUNDS} SELECT id, k, {R6.format('degrees(p10)')} AS lat, {R6.format('degrees(atan2(fy, fx))')} AS lon, {R3.format(f'sqrt(fx*fx + fy*fy) / cos(p10) - 6378.137 / sqrt(1 - {E2} * sin(p10) * sin(p10))')} AS height_km FROM l9""")
def geodetic_points(spark, sf_dir):
    """Geodetic coordinates by fixed-point rounds."""
    g, r, _ = states(spark, sf_dir)
    fixed = _settled(g.select("id", "k", *[x.alias(n) for x, n in zip(R.turned(r, R.gmst(F.col("us"))), "xyz", strict=True)]))  # not once a round
    lat, lon, height = R.geodetic(r)
    return fixed.select("id", "k", floored(lat).alias("lat"), floored(lon).alias("lon"), floored(height, 3).alias("height_km"))


@query(f"""WITH {STATES_SQL}, s AS (SELECT *, radians((280.460 + 0.9856474 * d) % 360) AS ml, radians((357.528 + 0.9856003 * d) % 360) AS g, radians(23.439 - 0.0000004 * d) AS eps FROM states), l AS (SELECT *, ml + radians(1.915) * sin(g) + radians(0.020) * sin(2 * g) AS lam, (1.00014 - 0.01671 * cos(g) - 0.00014 * cos(2 * g)) * 149597870.7 AS au FROM s), u AS (SELECT *, x * cos(lam) + y * cos(eps) * sin(lam) + z * sin(eps) * sin(lam) AS along FROM l)
SELECT id, k, {R6.format('cos(lam)')} AS sun_x, CASE WHEN along >= 0 THEN 'sunlit' WHEN sqrt(greatest(0, x*x + y*y + z*z - along * along)) < 6378.137 THEN 'eclipse' ELSE 'sunlit' END AS light FROM u""")
def sunlight(spark, sf_dir):
    """Direction of the sun and whether each object is in the Earth's shadow."""
    g, r, _ = states(spark, sf_dir)
    s = R.sun(F.col("us"))
    return g.select("id", "k", floored(s[0] / R.norm(s)).alias("sun_x"), R.illumination(r, F.col("us")).alias("light"))


@query(f"""WITH {STATES_SQL}, h AS (SELECT id, k, x, y, z, vx, vy * (1 + 0.001 * (1 + id % 5)) AS vy, vz, 398600.4418 AS mu FROM states), m AS (SELECT *, y*vz - z*vy AS hx, z*vx - x*vz AS hy, x*vy - y*vx AS hz, sqrt(x*x + y*y + z*z) AS rm, vx*vx + vy*vy + vz*vz AS v2, x*vx + y*vy + z*vz AS rv FROM h),
e AS (SELECT *, sqrt(hx*hx + hy*hy + hz*hz) AS hm, ((v2 - mu/rm) * x - rv * vx) / mu AS ex, ((v2 - mu/rm) * y - rv * vy) / mu AS ey, ((v2 - mu/rm) * z - rv * vz) / mu AS ez, v2 / 2 - mu / rm AS energy FROM m), f AS (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS e FROM e)
SELECT id, k, {R3.format('-mu / (2 * energy)')} AS a, {R6.format('e')} AS e, {R6.format('degrees(acos(greatest(-1, least(1, hz / hm))))')} AS i, CASE WHEN sqrt(hx*hx + hy*hy) > 1e-10 THEN {R6.format('(degrees(atan2(hx, -hy)) + 360) % 360')} ELSE 0 END AS raan FROM f""")
def orbit_elements(spark, sf_dir):
    """Semi-major axis, eccentricity, inclination and node of every state (angles of the apse are left to the tests)."""
    g, r, v = states(spark, sf_dir)
    g, e = _with_elements(g, r, [v[0], v[1] * (1 + 0.001 * (1 + F.col("id") % 5)), v[2]])
    return g.select("id", "k", floored(e["a"], 3).alias("a"), floored(e["e"]).alias("e"), floored(e["i"]).alias("i"), floored(e["raan"]).alias("raan"))


@query(f"""WITH {STATES_SQL}, h AS (SELECT *, sqrt(x*x + y*y + z*z) AS rm, y*vz - z*vy AS hx, z*vx - x*vz AS hy, x*vy - y*vx AS hz FROM states), w AS (SELECT *, hx / sqrt(hx*hx + hy*hy + hz*hz) AS wx, hy / sqrt(hx*hx + hy*hy + hz*hz) AS wy, hz / sqrt(hx*hx + hy*hy + hz*hz) AS wz FROM h)
SELECT id, k, {R6.format('0.01 * x / rm + 0.02 * (wy * z - wz * y) / rm + 0.03 * wx')} AS dx, {R6.format('0.01 * y / rm + 0.02 * (wz * x - wx * z) / rm + 0.03 * wy')} AS dy, {R6.format('0.01 * z / rm + 0.02 * (wx * y - wy * x) / rm + 0.03 * wz')} AS dz FROM w""")
def burns_in_space(spark, sf_dir):
    """A velocity change along radius, track and normal, in the inertial frame."""
    g, r, v = states(spark, sf_dir)
    d = R.inertial([F.lit(0.01), F.lit(0.02), F.lit(0.03)], r, v)
    return g.select("id", "k", *[floored(x).alias(n) for x, n in zip(d, ("dx", "dy", "dz"), strict=True)])


@query(f"""WITH p AS (SELECT c_custkey AS id, c_custkey % 160 - 80.0 AS lat, c_custkey * 7 % 360 - 180.0 AS lon, 400.0 + c_custkey % 300 AS alt, (1704067200000000 - 946728000000000 + c_custkey * 60000000) / 86400e6 AS d FROM customer), f AS (SELECT *, 6378.137 / sqrt(1 - {E2} * sin(radians(lat)) * sin(radians(lat))) AS n, radians((280.46061837 + 360.98564736629 * d + 0.000387933 * (d / 36525) * (d / 36525) - (d / 36525) * (d / 36525) * (d / 36525) / 38710000) % 360) AS th FROM p),
e AS (SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon) + th) AS x, (n + alt) * cos(radians(lat)) * sin(radians(lon) + th) AS y, (n * (1 - {E2}) + alt) * sin(radians(lat)) AS z FROM f), h AS (SELECT *, sqrt(x*x + y*y + z*z) AS rm, sqrt(x*x + y*y) AS fl, asin(greatest(-1, least(1, cos(radians(greatest(abs(lat) + 0.5, 51.6))) / greatest(1e-9, cos(radians(lat)))))) AS head FROM e), v AS (SELECT *, sqrt(398600.4418 / rm) AS sp FROM h)
SELECT id, {R3.format('x')} AS x, {R3.format('y')} AS y, {R3.format('z')} AS z, {R6.format('(-z * x / (rm * fl) * cos(head) - y / fl * sin(head)) * sp')} AS vx, {R6.format('(fl / rm * cos(head)) * sp')} AS vz FROM v""")
def orbits_over_points(spark, sf_dir):
    """Circular orbits over ground points."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 160 - 80.0).alias("lat"), (F.col("c_custkey") * 7 % 360 - 180.0).alias("lon"), (400.0 + F.col("c_custkey") % 300).alias("alt"), (F.lit(EPOCH_US) + F.col("c_custkey") * 60000000).alias("us"))
    r, v = R.orbit_over(F.col("lat"), F.col("lon"), F.col("alt"), F.col("us"), F.lit(51.6))
    return c.select("id", *[floored(x, 3).alias(n) for x, n in zip(r, "xyz", strict=True)], floored(v[0]).alias("vx"), floored(v[2]).alias("vz"))


@query(f"""WITH {STATES_SQL}, n AS (SELECT id, k, x AS p0, vx AS d0, lead(x) OVER w AS p1, lead(vx) OVER w AS d1 FROM states WINDOW w AS (PARTITION BY id ORDER BY k)) SELECT id, k, {R6.format('0.84375 * p0 + 0.140625 * 60 * d0 + 0.15625 * p1 - 0.046875 * 60 * d1')} AS x, {R6.format('-0.01875 * p0 + 0.1875 * d0 + 0.01875 * p1 - 0.3125 * d1')} AS vx FROM n WHERE p1 IS NOT NULL""")
def hermite_states(spark, sf_dir):
    """Position and speed a quarter of the way to the next node, by cubics."""
    g, _, _ = states(spark, sf_dir)
    w = Window.partitionBy("id").orderBy("k")
    n = g.withColumns({"p1": F.lead("x").over(w), "d1": F.lead("vx").over(w)}).where("p1 is not null")
    value, slope = R.hermite(F.lit(0.25), F.lit(60.0), F.col("x"), F.col("vx"), F.col("p1"), F.col("d1"))
    return n.select("id", "k", floored(value).alias("x"), floored(slope).alias("vx"))


@query("""WITH g AS (SELECT c_custkey AS id, (c_custkey % 37) * 10.0 AS total, 1.0 + c_custkey % 9 * 7 AS step FROM customer), t AS (SELECT id, total, unnest(CASE WHEN total <= 0 THEN [0.0] ELSE list_append(list_filter(list_transform(range(0, CAST(least(floor(total / step), 18) AS BIGINT) + 1), lambda k: k * step), lambda t: t < total - 1e-9), total) END) AS t FROM g) SELECT id, CAST(t AS DOUBLE) AS t FROM t""")
def time_grids(spark, sf_dir):
    """Sampling times with an exact end and at most twenty samples (the cap is the grid's own)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37 * 10.0).alias("total"), (1.0 + F.col("c_custkey") % 9 * 7).alias("step"))
    return c.select("id", F.explode(R.time_grid(F.col("total"), F.col("step"), 20)).alias("t"))


@query(f"""WITH {STATES_SQL}, h AS (SELECT id, k, x, y, z, vx, vy * (1 + 0.001 * (1 + id % 5)) AS vy, vz, 398600.4418 AS mu FROM states), m AS (SELECT *, y*vz - z*vy AS hx, z*vx - x*vz AS hy, x*vy - y*vx AS hz, sqrt(x*x + y*y + z*z) AS rm, vx*vx + vy*vy + vz*vz AS v2, x*vx + y*vy + z*vz AS rv FROM h),
e AS (SELECT *, sqrt(hx*hx + hy*hy + hz*hz) AS hm, ((v2 - mu/rm) * x - rv * vx) / mu AS ex, ((v2 - mu/rm) * y - rv * vy) / mu AS ey, ((v2 - mu/rm) * z - rv * vz) / mu AS ez FROM m), f AS (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS em, sqrt(hx*hx + hy*hy) AS nm FROM e),
t AS (SELECT id, k, (degrees(atan2((hx*ez*hx + hy*ez*hy + (-hy*ey - hx*ex)*hz) / (nm*em*hm), (-hy*ex + hx*ey) / (nm*em))) + 360) % 360 AS aop, (degrees(atan2(((ey*z - ez*y)*hx + (ez*x - ex*z)*hy + (ex*y - ey*x)*hz) / (em*rm*hm), (ex*x + ey*y + ez*z) / (em*rm))) + 360) % 360 AS ta FROM f)
SELECT id, k, floor(aop * 1e4 + 0.5) / 1e4 AS aop, floor(ta * 1e4 + 0.5) / 1e4 AS ta FROM t""")
def orbit_apses(spark, sf_dir):
    """Argument of the apse and true anomaly of every state."""
    g, r, v = states(spark, sf_dir)
    g, e = _with_elements(g, r, [v[0], v[1] * (1 + 0.001 * (1 + F.col("id") % 5)), v[2]])
    return g.select("id", "k", floored(e["aop"], 4).alias("aop"), floored(e["ta"], 4).alias("ta"))


@query("SELECT c_custkey AS id, CAST((i - 3) * 0.5 AS DOUBLE) AS offset_h, c_custkey % 72 + (i - 3) * 0.5e0 AS at_h FROM customer, range(7) AS r(i)")
def approach_grids(spark, sf_dir):
    """Seven times about each closest approach, the same number before and after."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 72).alias("tca_h"), F.explode(R.symmetric_grid(3, 0.5)).alias("offset_h"))
    return c.select("id", "offset_h", (F.col("tca_h") + F.col("offset_h")).alias("at_h"))


@query(f"""WITH {OBJECTS_SQL}, {GRID_SQL.replace('* 60.0', '* 1800.0').format(steps=49)}, c AS (SELECT id % 3 AS cloud, k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM grid WHERE id % 7 > k // 9 GROUP BY 1, 2),
d AS (SELECT c.cloud, c.k, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d FROM grid JOIN c ON grid.id % 3 = c.cloud AND grid.k = c.k WHERE grid.id % 7 > grid.k // 9)
SELECT cloud, k * 30e0 AS minutes, {R6.format('quantile_cont(d, 0.9)')} AS radius_km, {R6.format('quantile_cont(d, 0.5)')} AS radius_p50_km FROM d GROUP BY cloud, k HAVING count(*) >= 3""")
def radius_timeline(spark, sf_dir):
    """Radius of each cloud every half hour of a day, from the members still up; fewer than three give no point."""
    up = grid(objects(spark, sf_dir), 49, 1800.0).where("id % 7 > k div 9").withColumn("cloud", F.col("id") % 3)
    return radii(up, ["cloud", "k"]).select("cloud", (F.col("k") * 30.0).alias("minutes"), floored(F.col("p90_km")).alias("radius_km"), floored(F.col("p50_km")).alias("radius_p50_km"))
