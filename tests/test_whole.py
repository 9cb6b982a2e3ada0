"""Queries over every row of their tables, against brute force."""

from collections import defaultdict

from apsidal.operators.graph import breadth_first
from apsidal.plans import catalog
from apsidal.sources.derived import alerts, table


def test_depth_beyond_six_hops(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(50, 51)]
    got = breadth_first(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1,)], "node long"))
    assert sorted(map(tuple, got.collect())) == [(i + 1, i, 1) for i in range(20)]


def test_cascade_depth_follows_every_alert(spark, sf_dir):
    near = defaultdict(set)
    for r in alerts(spark, sf_dir).select("sat1", "sat2").collect():
        near[r.sat1].add(r.sat2)
        near[r.sat2].add(r.sat1)
    want, front = {1: 0}, [1]
    while front:
        front = {b for a in front for b in near[a]} - set(want)
        want |= dict.fromkeys(front, max(want.values()) + 1)
    assert sorted(map(tuple, catalog.cascade_depth(spark, sf_dir).collect())) == sorted(want.items())


def test_object_metadata_of_every_part(spark, sf_dir):
    got = {r.id: r.catalogue_number for r in catalog.object_metadata(spark, sf_dir).collect()}
    want = {r.p_partkey: (0 if r.p_partkey % 2 else (r.p_partkey // 2 % 24 + 10) * 10000) + r.p_partkey % 10000 for r in table(spark, sf_dir, "part").collect()}
    assert got == want


def test_unambiguous_owners_count_every_part(spark, tmp_path):
    rows = [(2, "A", 7), (102, "A", 7), (1, "A", 9), (101, "A", 8), (6, "B", 24)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalog.unambiguous_owners(spark, str(tmp_path)).collect()))
    assert got == [("A 2", 7), ("B 6", 24)]


def test_alert_merge_covers_every_alert(spark, sf_dir):
    first = {}
    for r in alerts(spark, sf_dir).collect():
        key = (r.sat1, r.sat2, r.alert_id % 3 == 0)
        first[key] = min(first.get(key, (r.alert_id, r.miss_km)), (r.alert_id, r.miss_km))
    want = {}
    for a, b, _ in first:
        p, e = first.get((a, b, False)), first.get((a, b, True))
        want[a, b] = (*(p or e), "both" if p and e else "physics" if p else "graph")
    assert {(r.sat1, r.sat2): (r.alert_id, r.miss_km, r.origin) for r in catalog.alert_merge(spark, sf_dir).collect()} == want
