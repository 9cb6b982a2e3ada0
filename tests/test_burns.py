"""Burns, engines, authority, gates and fragments on small cases, against plain Python."""

import math

from pyspark.sql import functions as F

from apsidal.functions import burns as B
from apsidal.operators import manoeuvres as ops
from apsidal.operators.encounters import followed_rate
from apsidal.sources.derived import grid, objects


def test_engine_choice(spark):
    rows = [(500.0, 0.5, 86400.0, 5400.0), (500.0, 0.5, 0.0, 5400.0), (420000.0, 2.0, 86400.0, 5400.0), (20.0, 0.001, 86400.0, 5400.0)]
    df = spark.createDataFrame(rows, "m double, dv double, lead double, period double")
    got = [r.e for r in df.select(B.engine_choice(B.engine_rows(*map(F.col, ("m", "dv", "lead", "period")))).alias("e")).collect()]

    def want(m, dv, lead, period):
        need = {n: m * (1 - math.exp(-dv / (i * B.G0))) for n, i, *_ in B.ENGINES}
        burn = {n: need[n] * i * B.G0 / t for n, i, t, _ in B.ENGINES}
        real = [n for n, *_, practical in B.ENGINES if practical]
        fit = [n for n in real if burn[n] <= min(0.1 * lead, 0.1 * period)]
        return min(fit, key=lambda n: (need[n], burn[n])) if fit else min(real, key=burn.get)

    assert got == [want(*r) for r in rows] and len(set(got)) > 1


def test_bound_share_keeps_below_escape(spark):
    rows = [(7000.0, 1.0, 0.0), (7000.0, 9.0, 0.0), (7000.0, -3.0, 14.0), (7000.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "r double, dx double, dy double")
    dv = [F.col("dx"), F.col("dy"), F.lit(0.0)]
    most = 0.99 * math.sqrt(2 * B.MU / 7000)
    for r in df.withColumn("s", B.bound_share(F.col("r"), [F.lit(7.5), F.lit(0.0), F.lit(0.0)], dv)).collect():
        free, held = math.hypot(7.5 + r.dx, r.dy), math.hypot(7.5 + r.s * r.dx, r.s * r.dy)
        assert r.s == 1.0 if free < most else abs(held - most) < 1e-9


def test_collision_bands(spark):
    ref, whole, emr = B.collision(F.col("a"), F.col("b"), F.col("v"))
    rows = spark.createDataFrame([(1.0, 1000.0, 10.0), (1.0, 1000.0, 5.0), (0.0, 0.0, 5.0)], "a double, b double, v double").select(ref.alias("r"), whole.alias("w"), emr.alias("e")).collect()
    assert [(r.r, r.w, r.e) for r in rows] == [(1001.0, True, 50000.0), (25.0, False, 12500.0), (0.0, False, 0.0)]


def test_authority_order(spark):
    cols = "s long, known boolean, expired boolean, kind string, admin boolean, owner string, covers boolean, listed boolean"
    rows = [
        (1, False, None, "DEB", None, "USA", None, True),
        (2, False, None, "PAY", None, "USA", None, True),
        (3, True, True, "PAY", True, "USA", True, True),
        (3, True, False, "R/B", True, "USA", True, True),
        (3, True, False, "PAY", True, "USA", False, True),
        (3, True, False, "PAY", False, "USA", True, True),
        (3, True, False, "PAY", False, "Unknown", True, True),
        (3, True, False, "PAY", False, "Unknown", False, False),
        (3, True, False, "PAY", False, "USA", False, True),
    ]
    rule = B.authority(*map(F.col, ("s", "known", "expired", "kind", "admin", "owner", "covers", "listed")))
    got = [r.r for r in spark.createDataFrame(rows, cols).select(rule.alias("r")).collect()]
    assert got == ["demo_session", "session_not_found", "session_expired", "object_not_manoeuvrable", "admin_session", "agency_match", "catalogued_owner_unresolved", "synthetic_object_no_owner", "agency_mismatch"]


def test_gates_fail_without_model_or_dry_run(spark):
    cols = "miss double, tca double, perigee double, dv double, need double, load double, ok boolean, flown boolean"
    df = spark.createDataFrame([(None, None, 400.0, 1.0, 1.0, 2.0, True, True), (4.0, 59.0, 99.0, 101.0, None, 2.0, None, True), (None, None, 400.0, 1.0, 1.0, 2.0, True, None)], cols)
    g = B.gates(*map(F.col, ("miss", "tca", "perigee", "dv", "need", "load", "ok", "flown")))
    clear, bad, dry = (tuple(r) for r in df.select(*[c.alias(n) for n, c in g.items()]).collect())
    assert clear == (True,) * 6 and bad == (False,) * 5 + (True,) and dry == (False, True, True, False, False, False)


def test_shortlist_spans_directions_and_choice_takes_each_branch(spark):
    cols = "alert_id long, mover long, owner_known boolean, dir int, mag int, dv double, miss double, pc9 double"
    rows = [(1, 7, True, d, m, 0.1 * (m + 1), 5.0 + m, 1e-7 if m >= 1 else 1e-5) for d in range(2) for m in range(4)]
    rows += [(2, 7, True, 0, m, 0.1 * (m + 1), 1.0, 1e-5 * (5 - m)) for m in range(5)] + [(3, 8, False, 0, 0, 0.5, 1.0, 1e-7), (3, 9, True, 0, 1, 2.0, 1.0, 1e-7)]
    picked = ops.shortlist(spark.createDataFrame(rows, cols), 1e-6)
    got = {}
    for r in picked.orderBy("alert_id", "place").collect():
        got.setdefault(r.alert_id, []).append((r.mover, r.dir, r.mag))
    assert got == {1: [(7, 0, 1), (7, 1, 1), (7, 0, 2), (7, 1, 2)], 2: [(7, 0, 1), (7, 0, 2), (7, 0, 3), (7, 0, 4)], 3: [(9, 0, 1), (8, 0, 0)]}
    for safe, secondary, want in (("place >= 2", "0e0", ("safe_target", 2)), ("false", "place * -1e-7", ("none_safe", 4)), ("CAST(NULL AS BOOLEAN)", "CAST(NULL AS DOUBLE)", ("pair_only", 1))):
        one = ops.final_choice(picked.where("alert_id = 1").withColumns({"cascade_safe": F.expr(safe), "secondary_pc": F.expr(secondary)})).first()
        assert (one.branch, one.chosen, one.naive) == (*want, 1)
    two = ops.final_choice(picked.where("alert_id = 2").withColumns({"cascade_safe": F.expr("place > 1"), "secondary_pc": F.lit(0.0)})).first()
    assert (two.branch, two.chosen, two.naive) == ("safe_reduction", 4, 4)
    assert ops.final_choice(picked.where("alert_id = 99").withColumns({"cascade_safe": F.lit(True), "secondary_pc": F.lit(0.0)})).isEmpty()


def test_fragment_hits_against_all_pairs(spark, sf_dir):
    o = objects(spark, sf_dir)
    f = o.selectExpr("id + 1000 AS id", "a_km + 1 AS a_km", "inc", "raan", "phase + 1e-3 AS phase")
    got = {(r.fragment, r.sat): (round(r.miss_km, 6), r.hits) for r in ops.fragment_hits(f, o, 61, 60.0, 25.0, F.expr("k >= 5 AND k < 40"), F.col("fragment") == F.col("sat") + 1001).collect()}
    at = lambda df: {(r.id, r.k): r for r in grid(df, 61).collect()}
    want, sats = {}, at(o)
    for (i, k), a in at(f).items():
        for (j, m), b in sats.items():
            if k == m and 5 <= k < 40 and i != j + 1001:
                d, v = [a[c] - b[c] for c in "xyz"], [a[f"v{c}"] - b[f"v{c}"] for c in "xyz"]
                t = max(-30.0, min(30.0, -sum(p * q for p, q in zip(d, v, strict=True)) / max(sum(q * q for q in v), 1e-12)))
                miss = math.sqrt(sum((p + q * t) ** 2 for p, q in zip(d, v, strict=True)))
                if miss < 25:
                    low, n = want.get((i, j), (1e9, 0))
                    want[i, j] = (min(low, round(miss, 6)), n + 1)
    assert want and set(got) == set(want) and all(abs(got[p][0] - want[p][0]) < 1e-5 and got[p][1] == want[p][1] for p in want)


def test_followed_rate(spark):
    rows = [(1, 0, 0, 0), (1, 1, 1000, 5000), (1, 2, 1050, 9000), (1, 3, 2050, 9000 + 6000), (1, 4, 3050, 100), (2, 5, 0, 0), (None, 6, 0, 0), (None, 7, None, 4), (None, 8, 1000, 3000)]
    got = followed_rate(spark.createDataFrame(rows, "o long, e long, c long, s long"), "o", "c", "s", "e").orderBy("e").collect()
    assert [round(r.rate, 9) for r in got] == [1.0, 5.0, 5.0, 5.2, 5.2, 1.0, 1.0, 1.0, 3.0]


def test_tasks_of_dealt_rows_follow_their_number(spark):
    rows = spark.range(5000).withColumnRenamed("id", "alert_id")
    assert ops.dealt(rows, "alert_id", 50).rdd.getNumPartitions() == 100
    assert ops.dealt(rows, "alert_id").rdd.getNumPartitions() == ops.dealt(rows, "alert_id", 5000).rdd.getNumPartitions() == 16
