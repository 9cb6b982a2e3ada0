"""Snapshot files, the first term of the series, radii of clouds, the closed demo session: small fixtures by hand or numpy."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from apsidal.functions import burns as B
from apsidal.functions import encounters as E
from apsidal.operators.spatial import radii
from apsidal.plans import reports
from apsidal.sources.catalogue import SNAPSHOT_COLUMNS, read_catalogue, snapshot_lines, write_catalogue_snapshot


def test_snapshot_round_trip(spark, tmp_path):
    names = list(SNAPSHOT_COLUMNS)
    row = lambda i, name, site: (i, name, "2020-001A", " pay", "+", "US", "2020-01-02", site, None, "90.5", "51.6", "420", "400", "0.4", "beyond")
    raw = spark.createDataFrame([row(" 5", 'A "b", c', "X, Y"), row("7", "SEVEN ", ""), row("x", "BAD", ""), row(None, "NONE", ""), row("9", "NOT TRACKED", ""), row("12", None, "Z")], ", ".join(f"{n} string" for n in [*names, "MORE"]))
    tracked = spark.createDataFrame([(5,), (7,), (7,), (12,), (99,)], "norad_id long")
    lines = dict(map(tuple, snapshot_lines(raw, tracked).collect()))
    assert lines == {5: '5,"A ""b"", c",2020-001A,pay,+,US,2020-01-02,"X, Y",,90.5,51.6,420,400,0.4', 7: "7,SEVEN,2020-001A,pay,+,US,2020-01-02,,,90.5,51.6,420,400,0.4", 12: "12,,2020-001A,pay,+,US,2020-01-02,Z,,90.5,51.6,420,400,0.4"}
    write_catalogue_snapshot(raw, tracked, f"{tmp_path}/snap", "file:satcat.csv", "2024-01-01T00:00Z")
    for path in glob.glob(f"{tmp_path}/snap/part-*"):
        text = open(path).read().split("\n")
        if text != [""]:
            assert text[0] == "# source=file:satcat.csv retrieved=2024-01-01T00:00Z rows=3 filter=ids of element files (4)" and text[1] == ",".join(SNAPSHOT_COLUMNS.values())
    back = read_catalogue(spark, f"{tmp_path}/snap")
    assert sorted((r.norad_id, r.object_type, r.owner, r.launch_year, r.rcs_m2) for r in back.collect()) == [(i, "PAY", "US", 2020, 0.4) for i in (5, 7, 12)]
    with pytest.raises(ValueError, match="RCS"):
        snapshot_lines(raw.drop("RCS"), tracked)


def test_first_term_from_tiny_to_huge_arguments(spark):
    y = [0.0, 1e-9, 0.3, 2.0, 9.9, 19.999, 20.0, 20.001, 45.0, 300.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in y], "y double").select(E.scaled_bessel(F.col("y"))).collect()]
    assert got == pytest.approx([float(np.i0(v) * np.exp(-v)) for v in y], rel=1e-7)  # what numpy's own approximation gives
    rows = [(0.3, 0.4, 0.01, 0.03, 0.05), (0.0, 0.0, 0.5, 0.5, 0.02), (5.0, 1.0, 1e-30, 0.0, 0.1), (9.0, 0.0, 0.1, 0.1, 2.0), (50.0, 0.0, 0.01, 0.01, 0.01)]
    out = [r[0] for r in spark.createDataFrame(rows, "b double, n double, tt double, nn double, r double").select(E.first_term_pc(*map(F.col, ("b", "n", "tt", "nn", "r")))).collect()]
    for (b, n, tt, nn, r), p in zip(rows, out, strict=True):
        s = (tt + nn) / 2
        u, x = r * r / (2 * s), (b * b + n * n) / (2 * s)
        want = 0.0 if s < 1e-20 else min(1.0, u * np.exp(2 * np.sqrt(u * x) - u - x) * (np.i0(2 * np.sqrt(u * x)) * np.exp(-2 * np.sqrt(u * x))))
        assert p == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_radii_need_three_points(spark):
    pts = [(1, float(i), float(i * i % 7), float(-i)) for i in range(9)] + [(2, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)]
    got = radii(spark.createDataFrame(pts, "k long, x double, y double, z double"), ["k"]).collect()
    a = np.array([p[1:] for p in pts[:9]])
    d = np.linalg.norm(a - a.mean(axis=0), axis=1)
    assert [(r.k, r.n) for r in got] == [(1, 9)] and (got[0].p50_km, got[0].p90_km) == pytest.approx(tuple(np.percentile(d, [50, 90])))


def test_demo_session_open_and_closed(spark):
    one = spark.range(1).select(F.lit(1).alias("s"), F.lit(True).alias("t"))
    rule = lambda open_: one.select(B.authority(F.col("s"), F.col("t"), ~F.col("t"), F.lit("PAY"), ~F.col("t"), F.lit("US"), F.col("t"), F.col("t"), demo_open=open_)).first()[0]
    assert rule(True) == "demo_session" and rule(False) == "demo_session_disabled"
    assert "demo_session_disabled" not in B.ALLOWING


def test_sentences_without_facts(spark):
    from apsidal.functions import text as T

    none = lambda t: F.lit(None).cast(t)
    event = "struct<event_id:int,state:string,window_h:double,own:boolean,t_rel_s:double,fragments:int,inside:int,nearest_km:double,later:array<struct<minutes:double,p90_km:double>>>"
    r = spark.range(1).select(
        T.area(F.lit(0.5), none("double"), none("double"), none("double"), none("double"), F.lit("three_sigma"), F.lit(0)).alias("area"),
        T.closest(none("string"), F.lit("B"), F.lit(1.0), none("double"), F.lit(3.0), F.lit(0.0), none("double"), none("double"), none("string"), none("string")).alias("alone"),
        T.closest(F.lit("A"), F.lit("B"), F.lit(1.0), none("double"), F.lit(3.0), F.lit(0.0), none("double"), none("double"), none("string"), none("string")).alias("pair"),
        T.effect(none("int"), F.lit(0), F.lit(0), F.lit(0), F.lit(4)).alias("effect"),
        T.debris(none(f"array<{event}>"), none("int"), none("boolean")).alias("unknown"),
        T.debris(F.from_json(F.lit('[{"event_id": 7, "state": "released", "own": true, "t_rel_s": 0.0, "fragments": 9, "inside": 0, "later": []}, {"event_id": 8, "state": "odd"}, {"event_id": 9, "state": "released", "own": false, "inside": 0}]'), f"array<{event}>"), none("int"), none("boolean")).alias("events"),
    ).first()
    assert r.area == "A sphere of radius 500 m centred at an unresolved location at n/a. The radius comes from three sigma; 0 tracked object(s) are inside it at that instant."
    assert r.alone == T.NO_APPROACH and r.pair == "A and B pass 1.00 km apart (T-3 min). Collision probability (Foster) 0; severity n/a."
    assert r.effect == T.NO_OPTION + "4 object(s) are downstream of this zone in the cascade graph." and r.unknown == T.NO_BREAKUP + T.RUN_DEBRIS
    assert r.events == "Debris layer: this is the breakup point of event 7: ~9 fragments ≥10 cm are released here; no fragment of event 9 is inside the zone at TCA (nearest n/a)."


def test_alert_queue_cuts_before_it_makes_rows_unique(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.unionByName(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    queue = reports.alert_queue(spark, str(tmp_path))
    assert sorted(map(tuple, queue.collect())) == sorted(map(tuple, reports.alert_queue(spark, sf_dir).collect()))
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Window")
