"""Every query against its oracle; kernels against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from apsidal.functions import encounters as E
from apsidal.functions import kernels
from apsidal.functions import frames
from apsidal.operators.screening import overlapping, screened
from apsidal.plans import cascade, catalog, explanations, manoeuvres, objects as object_plans, reports, review, scores, statistics  # noqa: F401 (each registers its queries)
from apsidal.plans import frames as frame_plans  # noqa: F401
from apsidal.sources.catalogue import read_catalogue, read_element_files, read_scenarios, write_snapshot
from apsidal.sources.derived import objects

from .oracle import mismatch


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, name):
    got, want, bad = mismatch(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)
    assert got == want and not bad, (got, want, bad)


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["id1", "id2", "tca_s", "miss_km", "hits", "severity"] and not found.isEmpty()
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_conjunction_index_knots(spark):
    rows = [(0.1, 1e-2, 1.0, 15.0, 168.0, 10.0), (1.0, 0.0, 24.0, 0.0, 0.0, 7 * 0.4 + 2 * 0.15), (200.0, 1e-6, 64.0, 7.5, 84.0, 0.5 * 0.4 + 0.5 + 0.25)]
    df = spark.createDataFrame(rows, "m double, p double, t double, v double, a double, want double")
    for r in df.select("want", E.conjunction_index(*map(F.col, "mptva")).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-9


def test_screening_finds_every_pair(spark, sf_dir):
    """Best encounters against a scan of all pairs at one second about their grid minima."""
    objs = {r.id: r for r in objects(spark, sf_dir).collect()}
    got = {(r.id1, r.id2): r for r in screened(objects(spark, sf_dir), 361, 60.0, 25.0).collect()}

    def states(r, t):
        n = math.sqrt(E.MU_KM3_S2 / r.a_km**3)
        u, c, s = r.phase + n * t, math.cos(r.raan), math.sin(r.raan)
        return r.a_km * np.stack([c * np.cos(u) - s * math.cos(r.inc) * np.sin(u), s * np.cos(u) + c * math.cos(r.inc) * np.sin(u), math.sin(r.inc) * np.sin(u)], 1)

    t = np.arange(0, 360 * 60, 0.5)
    tracks = {i: states(r, t) for i, r in objs.items()}
    want = {}
    for i in objs:
        for j in objs:
            if i < j:
                d = np.linalg.norm(tracks[i] - tracks[j], axis=1)
                if d[:-1].min() <= 24.9:
                    want[i, j] = d.min()
    assert want and set(want) <= set(got)
    assert all(got[k].miss_km <= want[k] + 1e-6 and want[k] - got[k].miss_km < 2.5 for k in want)


def test_overlapping_intervals(spark):
    import random

    rng = random.Random(3)
    rows = [(i, low, low + rng.choice([0.5, 1.0, 30.0])) for i, low in enumerate(rng.uniform(0, 400) for _ in range(120))]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1] <= b[2] and b[1] <= a[2]}
    for width in (3.0, 1000.0):
        assert {r.id for r in overlapping(spark.createDataFrame(rows, "id int, low double, high double"), width).collect()} == want


def test_disk_probability():
    m, s, r = np.array([0.5, 3.0, 0.0]), np.array([0.7, 1.5, 0.2]), np.array([0.02, 0.5, 1.0])
    iso = kernels.disk_probability(m, np.zeros(3), s * s, np.zeros(3), s * s, r)
    rng = np.random.default_rng(1)
    for k in range(3):
        x = rng.normal(0, s[k], (2_000_000, 2)) + [m[k], 0]
        if k:
            assert abs((np.hypot(*x.T) <= r[k]).mean() - iso[k]) < 2e-3
    assert math.isclose(iso[0], r[0] ** 2 / (2 * s[0] ** 2) * math.exp(-(m[0] ** 2) / (2 * s[0] ** 2)), rel_tol=1e-3)
    # three published geometries: isotropic, five to one, turned by thirty degrees
    c, z = math.cos(math.pi / 6), math.sin(math.pi / 6)
    bx, by, h = np.array([0.15, 0.2, 0.3]), np.array([0.0, 0.05, -0.2]), np.array([0.02, 0.015, 0.05])
    cxx = np.array([0.04, 0.25, c * c + z * z * 0.09])
    cxy = np.array([0.0, 0.0, c * z * (1 - 0.09)])
    cyy = np.array([0.04, 0.01, z * z + c * c * 0.09])
    want = [3.767424e-3, 1.828925e-3, 2.303082e-3]
    assert np.allclose(kernels.disk_probability(bx, by, cxx, cxy, cyy, h), want, rtol=1e-4)
    assert np.allclose(kernels.chan_probability(bx, by, cxx, cxy, cyy, h), want, rtol=5e-2)
    assert (kernels.largest_probability(bx, by, cxx, cxy, cyy, h) >= np.array(want) * 0.999).all()


def test_principal_axes(spark, sf_dir):
    rows = np.array([[np.nan if v is None else v for v in r] for r in statistics.holes(spark, sf_dir).select(*statistics.HOLES).collect()], float)
    rows = np.where(np.isnan(rows), np.nanmedian(rows, axis=0), rows)
    values = np.linalg.eigvalsh(np.corrcoef(rows.T))[::-1]
    got = [r.share for r in statistics.principal_axes(spark, sf_dir).orderBy("component").collect()]
    assert np.allclose(got, values / values.sum(), atol=1e-5)


def test_elements_of_an_eccentric_orbit(spark):
    df = spark.createDataFrame([(7000.0, 0.0, 0.0, 0.0, 5.0, 6.5), (7000.0, 0.0, 0.0, 0.0, (398600.4418 / 7000) ** 0.5, 0.0), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "x double, y double, z double, vx double, vy double, vz double")
    e = frames.elements([F.col(c) for c in "xyz"], [F.col(c) for c in ("vx", "vy", "vz")])
    oval, ring, none = df.select(*[c.alias(n) for n, c in e.items()]).collect()
    assert oval.e > 0.1 and abs(oval.aop) % 360 < 1e-6 and abs(oval.ta) % 360 < 1e-6
    assert ring.e < 1e-9 and ring.i == 0 and ring.raan == 0 and none.a is None


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "tle").mkdir()
    (tmp_path / "tle/a.txt").write_text("0 ISS (ZARYA)\n1 25544U 98067A\n2 25544  51.6\n\n0 LOST\n1 00001U\n0 TWO\r\n1 T0001U\r\n2 x\r\n")
    got = read_element_files(spark, str(tmp_path / "tle")).orderBy("line_no").collect()
    assert [(r.name, r.norad_id) for r in got] == [("ISS (ZARYA)", 25544), ("TWO", 0)]
    assert read_element_files(spark, str(tmp_path / "tle"), 1).count() == 1
    (tmp_path / "cat.csv").write_text("# a note\nnorad_id,name,object_type,owner,launch_date,rcs_m2\n5,VANGUARD 1,PAY,US,1958-03-17,0.12\nbad,X,PAY,US,,\n7,,deb,,oops,n/a\n")
    rows = read_catalogue(spark, str(tmp_path / "cat.csv"))
    assert sorted((r.norad_id, r.name, r.object_type, r.launch_year, r.rcs_m2) for r in rows.collect()) == [(5, "VANGUARD 1", "PAY", 1958, 0.12), (7, None, "DEB", None, None)]
    write_snapshot(rows, spark.createDataFrame([(5,), (9,)], "norad_id long"), str(tmp_path / "snap"))
    assert [r.norad_id for r in spark.read.csv(str(tmp_path / "snap"), header=True, inferSchema=True).collect()] == [5]
    (tmp_path / "hotspot.json").write_text('{"name": "H",\n "crossing": {"encounter_minutes": 20}}')
    assert read_scenarios(spark, str(tmp_path / "hotspot.json")).first().scenario == "hotspot"
