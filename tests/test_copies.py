"""Objects that share an orbit: pairs are sought between different orbits only, and every object is still named."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from apsidal.operators import manoeuvres, screening, spatial
from apsidal.plans import catalog, frames, space
from apsidal.plans import manoeuvres as plans

from .oracle import mismatch


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Suppliers whose orbits repeat: even keys after 7 200, all keys after 50 400."""
    folder = tmp_path_factory.mktemp("copied")
    pq.write_table(pa.table({"s_suppkey": [*range(60), *range(7200, 7230), *range(50400, 50420)]}), f"{folder}/supplier.parquet")
    return str(folder)


def test_corridors_of_copies(spark, copied, monkeypatch):
    """Ten burns of 75 orbits fly, not of 110 objects."""
    flown = []
    monkeypatch.setattr(space.ops, "corridor_hits", lambda movers, *rest, seek=manoeuvres.corridor_hits: (flown.append(movers.count()), seek(movers, *rest))[1])
    got, want, bad = mismatch(spark, space.burn_corridors, catalog.ORACLES["burn_corridors"], copied)
    assert got == want > 0 and not bad, (got, want, bad)
    assert flown == [750]


@pytest.mark.parametrize("name", ["screening", "capped_candidates"])
def test_pairs_of_copies(spark, copied, monkeypatch, name):
    """The search reads 75 orbits; its pairs, those of copies too, are named by all 110 objects."""
    read = []
    monkeypatch.setattr(screening, "_candidates", lambda objs, *rest, seek=screening._candidates: (read.append(objs.count()), seek(objs, *rest))[1])
    got, want, bad = mismatch(spark, catalog.QUERIES[name], catalog.ORACLES[name], copied)
    if name == "capped_candidates":  # the time of approach of two copies is any time
        assert not bad, bad
    assert got == want > 0 and read == [75]


def test_bands_hold_every_pair(spark):
    """Radii that differ by at most the width share one band exactly once."""
    a = [(i, 6800.0 + 7.3 * i) for i in range(60)]
    df = spark.createDataFrame(a, "id long, a_km double")
    one, two = screening.in_bands(df, 25.0), screening.in_bands(df, 25.0, both=True).select(F.col("id").alias("other"), "band")
    met = [(r.id, r.other) for r in one.join(two, "band").collect()]
    assert len(met) == len(set(met)) and {(i, j) for i, x in a for j, y in a if abs(x - y) <= 25.0} <= set(met)


@pytest.mark.parametrize("name", ["fragment_screening", "fragment_exposure"])
def test_fragments_of_copies(spark, copied, monkeypatch, name):
    """Fragments of parents alike fly once, against one object of every orbit."""
    flown = []
    monkeypatch.setattr(plans.ops, "fragment_hits", lambda parts, objs, *rest, seek=manoeuvres.fragment_hits: (flown.append((parts.count(), objs.count())), seek(parts, objs, *rest))[1])
    got, want, bad = mismatch(spark, catalog.QUERIES[name], catalog.ORACLES[name], copied)
    assert got == want > 0 and not bad, (got, want, bad)
    assert flown == [(300, 75)]


def test_states_of_one_file(spark, sf_dir):
    """A catalogue of one file is dealt before its steps are laid out, so many tasks compute the states."""
    assert frames.states(spark, sf_dir)[0].rdd.getNumPartitions() >= 8


def test_holders_as_words(spark, monkeypatch):
    """What is kept of 640 holders of the same elements is 64 to a row, not a row each; sets still get every holder."""
    kept = []
    monkeypatch.setattr(spatial, "checkpoint", lambda df, keep=spatial.checkpoint: (kept.append(keep(df)), kept[-1])[1])
    holders = spark.createDataFrame([(h, e) for h in range(640) for e in (1, 2, 3) if h % 7 or e < 3], "h long, element long")
    sets = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3), (12, 3), (12, 4)], "s long, element long")
    got = sorted((r.s, r.h) for r in spatial.contained(sets, holders).collect())
    assert got == [(10, h) for h in range(640)] + [(11, h) for h in range(640) if h % 7]
    assert max(df.count() for df in kept) <= 640 < holders.count()


def test_neighbours_of_copies(spark, copied, monkeypatch):
    """All 110 objects ask, each at its own time, for what 75 orbits hold; every object of these is named."""
    read = []
    monkeypatch.setattr(spatial, "near_orbits", lambda queries, orbits, *rest, seek=spatial.near_orbits: (read.append((queries.count(), orbits.count())), seek(queries, orbits, *rest))[1])
    got, want, bad = mismatch(spark, space.neighbours, catalog.ORACLES["neighbours"], copied)
    assert got == want > 0 and not bad, (got, want, bad)
    assert read == [(110, 75)]


@pytest.mark.parametrize("names", [1, 5, 1 << 26])
def test_cells_that_share_a_name(spark, copied, monkeypatch, names):
    """What is near is found once, however few names the cells of a level have."""
    monkeypatch.setattr(spatial, "CELL_NAMES", names)
    got, want, bad = mismatch(spark, space.neighbours, catalog.ORACLES["neighbours"], copied)
    assert got == want > 0 and not bad, (got, want, bad)


def test_near_points_without_broadcast(spark, copied):
    """More orbits than are broadcast give the same pairs."""
    o = space.objects(spark, copied)
    at = space.states_at(o.selectExpr("*", "id % 7 * 3600 + 0.25 AS k"), 1.0)
    q = at.select(F.col("id").alias("q"), F.col("k").cast("double").alias("t_s"), "x", "y", "z", (F.col("id") % 3 * 900.0).alias("radius_km"))
    some, all_ = (sorted((r.q, r.id, round(r.distance_km, 6)) for r in spatial.near_points(q, o, most=n).collect()) for n in (10, 1000))
    assert some == all_ and len(some) > 200


@pytest.fixture(scope="module")
def alerted(tmp_path_factory):
    """Sixty objects on one orbit, some others on orbits alike, and alerts of them: repeated rows, second objects inside and outside the catalogue."""
    folder = tmp_path_factory.mktemp("alerted")
    keys = sorted({*(7200 * i for i in range(60)), *range(40), *range(50400, 50420)})
    rows = [(i, keys[i * 7 % len(keys)], keys[(i * 7 + 1 + i % 11) % len(keys)] if i % 3 else 900000 + i, 1 + i % 4, float(i % 50)) for i in range(400)]
    rows = [r for r in rows if r[1] != r[2]] + rows[:30]
    pq.write_table(pa.table({"s_suppkey": keys}), f"{folder}/supplier.parquet")
    names = ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"]
    pq.write_table(pa.table({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}), f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["zone_objects", "forecast_members"])
def test_zones_of_copies(spark, alerted, monkeypatch, name):
    """Centres are those of orbits; a zone moves once, to the list of its centre, and no object of it moves at all."""
    asked = []
    monkeypatch.setattr(spatial, "near_orbits", lambda queries, *rest, seek=spatial.near_orbits: (asked.append(queries.count()), seek(queries, *rest))[1])
    got, want, bad = mismatch(spark, catalog.QUERIES[name], catalog.ORACLES[name], alerted)
    assert got == want > 300 and not bad, (got, want, bad)
    o = space.objects(spark, alerted)
    z = space.zones(spark, alerted).join(o, F.col("sat1") == o["id"])
    assert asked == [z.select("t_s", *screening.ORBIT).distinct().count()] and asked[0] < z.select("t_s", "sat1").distinct().count()
    plan = catalog.QUERIES[name](spark, alerted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(one") == plan.count("Exchange hashpartitioning") == 2
