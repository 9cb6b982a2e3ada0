"""Spatial joins, encounter geometry and envelopes against plain Python and numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from apsidal.functions import vectors
from apsidal.operators import geometry, manoeuvres, screening, spatial, statistics
from apsidal.plans import space
from apsidal.sources.derived import objects


def position(o, t):
    u = o.phase + math.sqrt(398600.8 / o.a_km**3) * t
    return np.array([o.a_km * (math.cos(o.raan) * math.cos(u) - math.sin(o.raan) * math.cos(o.inc) * math.sin(u)), o.a_km * (math.sin(o.raan) * math.cos(u) + math.cos(o.raan) * math.cos(o.inc) * math.sin(u)), o.a_km * math.sin(o.inc) * math.sin(u)])


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(i, 6900.0 + i % 7 * 60.0, 0.3 + i % 5 * 0.3, i * 0.37 % 6.28, i * 0.91 % 6.28) for i in range(60)]
    rows += [(100 + i, 6900.0, 0.5, 1.0, 2.0 + i * 1e-3) for i in range(30)]  # a crowd in one cell
    return spark.createDataFrame(rows, "id long, a_km double, inc double, raan double, phase double")


def test_near_points(spark, catalogue):
    objs = catalogue.collect()
    rng = np.random.default_rng(3)
    rows = []
    for q in range(150):
        o, t = objs[q % len(objs)], float(rng.uniform(0, 20000)) if q % 3 else 60.0 * q
        x = position(o, t) + rng.normal(0, 30, 3)
        rows.append((q, t, *map(float, x), float([0.0, 5.0, 60.0, 400.0, 3000.0][q % 5])))
    got = {(r.q, r.id): r.distance_km for r in spatial.near_points(spark.createDataFrame(rows, "q long, t_s double, x double, y double, z double, radius_km double"), catalogue).collect()}
    want = {(q, o.id): float(np.linalg.norm(position(o, t) - np.array(x))) for q, t, *x, r in rows for o in objs if np.linalg.norm(position(o, t) - np.array(x)) <= r}
    assert got.keys() == want.keys() and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_contained(spark):
    rng = np.random.default_rng(5)
    holders = {h: {int(x) for x in rng.integers(0, 30, 12)} | {99} for h in range(25)}
    sets = {s: {int(x) for x in rng.integers(0, 30, 1 + s % 3)} | ({99} if s % 2 else set()) for s in range(80)} | {500: {99}, 501: {1234}, 502: {99, 1234}}
    df = lambda d, n: spark.createDataFrame([(k, x) for k, xs in d.items() for x in xs] * 2, f"{n} long, element long")
    got = Counter((r.s, r.h) for r in spatial.contained(df(sets, "s"), df(holders, "h")).collect())
    assert got == Counter((s, h) for s, xs in sets.items() for h, ys in holders.items() if xs <= ys)


def test_pair_minima_against_a_dense_scan(spark, catalogue):
    objs = {o.id: o for o in catalogue.collect()}
    step, steps, rows, pairs = 30.0, 240, [], [(0, 7), (3, 11), (20, 41), (5, 19), (100, 101)]
    state = lambda o, t: (position(o, t), (position(o, t + 1e-3) - position(o, t - 1e-3)) / 2e-3)
    for n, (a, b) in enumerate(pairs):
        for k in range(steps):
            (r1, v1), (r2, v2) = state(objs[a], k * step), state(objs[b], k * step)
            rows.append((n, k, *map(float, r2 - r1), *map(float, v2 - v1)))
    got = spatial.pair_minima(spark.createDataFrame(rows, "pair long, k int, dx double, dy double, dz double, dvx double, dvy double, dvz double").repartition(4), step).collect()
    for n, (a, b) in enumerate(pairs):
        ts = np.arange(0, (steps - 1) * step + 1e-9, 0.05)
        d = np.array([np.linalg.norm(position(objs[a], t) - position(objs[b], t)) for t in ts])
        own = [r for r in got if r.pair == n]
        best = min(own, key=lambda r: r.d_km)
        assert abs(best.d_km - d.min()) < 2e-3
        inner = [i for i in range(1, len(d) - 1) if d[i] <= d[i - 1] and d[i] <= d[i + 1]]
        for r in own:  # every kept minimum is one of the scan, or an end of the window
            assert r.bound <= r.d_km + 1e-9 and (any(abs(ts[i] - r.t_s) < 0.2 for i in inner) or r.t_s in (0.0, (steps - 1) * step))
        assert len(own) <= own[0].minima


def test_encounter_covariance_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in range(40):
        r1, v1 = rng.normal(0, 4000, 3) + [5000, 0, 0], rng.normal(0, 4, 3)
        r2, v2 = r1 + rng.normal(0, 5, 3), v1 + rng.normal(0, [1e-2, 5][n % 2], 3)
        if n == 5:
            v2 = v1
        if n == 6:
            v2 = v1 + r1 / 1000  # along the first object's position
        rows.append((n, *map(float, [*r1, *v1, *r2, *v2]), float(n % 7), float(n % 4)))
    names = [f"{v}{c}{s}" for s in "12" for v in ("", "v") for c in "xyz"]
    df = spark.createDataFrame(rows, "n long, " + ", ".join(f"{c} double" for c in names) + ", g1 double, g2 double")
    for r in geometry.encounter_covariance(df, F.col("g1"), F.col("g2")).collect():
        r1, v1, r2, v2 = (np.array([r[f"{v}{c}{s}"] for c in "xyz"]) for s in "12" for v in ("", "v"))
        total = np.zeros((3, 3))
        for x, v, age in ((r1, v1, r.g1), (r2, v2, r.g2)):
            a = x / np.linalg.norm(x)
            c = np.cross(x, v) / np.linalg.norm(np.cross(x, v))
            q = np.column_stack([a, np.cross(c, a), c])
            total += q @ np.diag([(0.1 + 0.1 * age) ** 2, (0.5 + age) ** 2, (0.15 + 0.1 * age) ** 2]) @ q.T
        dv = v2 - v1
        speed = np.linalg.norm(dv)
        e = dv / speed if speed > 1e-9 else np.array([1.0, 0, 0])
        t = np.cross(e, r1)
        t = np.cross(e, [0, 0, 1.0]) if np.linalg.norm(t) < 1e-9 else t
        t = t / np.linalg.norm(t)
        plane = np.vstack([t, np.cross(t, e)])
        c2, b = plane @ total @ plane.T, plane @ (r2 - r1)
        if r.n != 6:  # there the axis is a difference of rounding
            assert np.allclose([r.b_t, r.b_n, r.c_tt, r.c_tn, r.c_nn], [*b, c2[0, 0], c2[0, 1], c2[1, 1]], rtol=1e-7, atol=1e-7)
            w, u = np.linalg.eigh(c2)
            assert np.allclose([r.a_m, r.b_m], [3000 * math.sqrt(w[1]), 3000 * math.sqrt(max(w[0], 0))], rtol=1e-6)
            assert abs(math.sin(r.angle - math.atan2(u[1, 1], u[0, 1]))) < 1e-5
        assert np.isclose(r.c_tt + r.c_nn, np.trace(c2)) and r.short_encounter == (speed >= 0.1)


def test_least_axis(spark):
    rng = np.random.default_rng(2)
    points = [rng.normal(0, 1, (9, 3)) * rng.uniform(0.1, 9, 3) for _ in range(20)]
    rows = [tuple(float(x) for x in (p.T @ p)[np.triu_indices(3)]) for p in points]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    for r, row in zip(vectors.with_least_axis(df, [F.col(c) for c in "abcdef"], "h").collect(), rows, strict=True):
        m = np.array([[row[0], row[1], row[2]], [row[1], row[3], row[4]], [row[2], row[4], row[5]]])
        h = np.linalg.eigh(m)[1][:, 0]
        assert abs(abs(h @ np.array(r.h)) - 1) < 1e-9


def test_along_track_spread(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(8):
        n = [2, 3, 50, 400][g % 4]
        u = rng.normal(1.0, 0.2 + g * 0.1, n)
        p = np.column_stack([7000 * np.cos(u), 7000 * np.sin(u) * math.cos(0.7), 7000 * np.sin(u) * math.sin(0.7)]) + rng.normal(0, 20, (n, 3))
        rows += [(g, i, *map(float, x)) for i, x in enumerate(p)]
        if n >= 3:
            h = np.linalg.svd(p, full_matrices=False)[2][-1]
            c = p.mean(axis=0)
            e1 = c - (c @ h) * h
            e1 /= np.linalg.norm(e1)
            th = np.arctan2(p @ np.cross(h, e1), p @ e1)
            lo, hi = np.percentile(th, [5, 95])
            want[g] = min(hi - lo, 2 * math.pi) * np.linalg.norm(p, axis=1).mean()
    got = {r.g: r.spread_km for r in geometry.along_track_spread(spark.createDataFrame(rows, "g long, id long, x double, y double, z double"), ["g"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-6 * want[g] + 1e-6 for g in want)


def test_corridors_and_session_setting(spark, catalogue):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    movers = catalogue.where("id < 20").select((F.col("id") + 1000).alias("id"), F.col("a_km") + 1.0, "inc", "raan", F.col("phase") + 1e-4).toDF("id", "a_km", "inc", "raan", "phase")
    gate = F.lit(5.0) + F.col("fragment") % 4 * 10
    got = {(r.fragment, r.sat): r.miss_km for r in manoeuvres.corridor_hits(movers, catalogue, 31, 60.0, gate, 35.0, F.lit(False)).collect()}
    objs, own = catalogue.collect(), movers.collect()
    for m in own:
        for o in objs:
            least = 1e9
            for k in range(31):
                d, v = position(m, k * 60) - position(o, k * 60), (position(m, k * 60 + 0.01) - position(m, k * 60 - 0.01) - position(o, k * 60 + 0.01) + position(o, k * 60 - 0.01)) / 0.02
                t = max(-30.0, min(30.0, -(d @ v) / max(v @ v, 1e-12)))
                least = min(least, float(np.linalg.norm(d + v * t)))
            limit = 5.0 + m.id % 4 * 10
            if abs(least - limit) > 1e-3:
                assert ((m.id, o.id) in got) == (least < limit), (m.id, o.id, least)
    assert len(got) > 10
    screening.candidates(catalogue, 5, 60.0, 25.0).count()
    assert spark.conf.get(name) == before


def test_quantiles_with_an_outlier(spark):
    rng = np.random.default_rng(8)
    groups = {"a": [*rng.normal(0, 1, 5000), 1e12], "b": [2.0] * 3000, "c": [1.0], "d": [*np.round(rng.normal(0, 1, 4000), 1), -1e9]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)], "g string, x double").repartition(5)
    for most in (100_000, 200):
        for r in statistics.histogram_quantiles(df, ["g"], "x", [0.05, 0.5, 0.95], bins=64, most=most).collect():
            assert np.allclose([r.q0, r.q1, r.q2], np.quantile(groups[r.g], [0.05, 0.5, 0.95])) and r.n == len(groups[r.g])


def test_states_of_pairs_are_not_moved(spark, sf_dir):
    """Pairs are dealt before their steps are laid out: windows over a pair need no exchange above the steps."""
    w = Window.partitionBy("pair").orderBy("k")
    plan = space._relative(spark, sf_dir).withColumn("before", F.lag("dx").over(w))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan.split("Generate")[1] and "Exchange" not in plan.split("Generate")[0]


def test_minimum_of_a_pair_seen_once(spark):
    row = (5, 3, 3.0, 0.0, 4.0, 1.0, 0.0, 0.0)
    got = spatial.pair_minima(spark.createDataFrame([row], "pair long, k int, dx double, dy double, dz double, dvx double, dvy double, dvz double"), 60.0).collect()
    assert [tuple(r) for r in got] == [(5, 180.0, 5.0, -55.0, 1)]


def test_zones_of_one_centre(spark, catalogue):
    """Zones that share a centre are searched once: each has its own radius still, and the nearest of a centre hold those of its zones."""
    o = catalogue.limit(40).collect()
    rows = [(10 * i + j, x.id, 60.0 * i, *map(float, position(x, 60.0 * i)), 300.0 + 900 * j) for i, x in enumerate(o) for j in range(3)]
    z = spark.createDataFrame(rows, "q long, sat1 long, t_s double, x double, y double, z double, radius_km double")
    apart = {}
    objs = catalogue.collect()
    for r in rows:
        for s in objs:
            d = float(np.linalg.norm(position(s, r[2]) - np.array(r[3:6])))
            if d <= r[6]:
                apart[r[0], s.id] = d
    got = {(r.q, r.id): r.distance_km for r in space.zone_pairs(z, catalogue).collect()}
    assert got.keys() == apart.keys() and all(abs(got[k] - apart[k]) < 1e-6 for k in got)
    some = {(r.q, r.id) for r in space.zone_pairs(z, catalogue, 5).collect()}
    for q in {k[0] for k in apart}:
        nearest = sorted((math.floor(d * 1e6 + 0.5), i) for (p, i), d in apart.items() if p == q)[:5]
        assert {(q, i) for _, i in nearest} <= some
