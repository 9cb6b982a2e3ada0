"""Advisory rankers against plain Python, edge by edge."""

import math

import pytest

from apsidal.operators.review import burn_geometry, ranker_review, summary_features

NODES = [(1, 7000.0, 7.5, 629.0, 1.0, 6.0), (2, 7200.0, 7.4, 829.0, 2.0, 9.0), (3, 7400.0, 7.3, 1029.0, 1.0, 0.0), (4, 8000.0, 7.0, 1629.0, 3.0, 2.5)]
EDGES = [(1, 2, 1e-4, 0.5, 36000.0, 30.0), (2, 1, 1e-6, 5.0, 9000.0, -10.0), (2, 3, 0.2, 60.0, 18000.0, 600.0), (3, 99, 0.9, 0.1, 1.0, 1.0), (1, 3, None, 1.0, 1.0, 1.0)]
SCHEMAS = "node long, r_km double, v_kms double, altitude_km double, agency double, peak_index double", "a long, b long, pc double, miss_km double, speed_kmh double, tca_min double"


def brute():
    ids = {n[0] for n in NODES}
    seen = {i: [] for i in ids}
    reach = dict.fromkeys(ids, 0.0)
    for a, b, pc, miss, speed, tca in EDGES:
        if pc is None or not {a, b} <= ids:
            continue
        for u, v in ((a, b), (b, a)):
            w = 0.45 * pc + 0.25 * math.exp(-miss / 120) + 0.15 * min(speed / 18000, 1) + 0.15 * math.exp(-max(tca, 0) / 180)
            reach[u] += w * 0.75
            reach[v] += w
            for x in (u, v):
                seen[x].append((pc, 1 / (1 + miss), tca, speed))
    out = {}
    for i, r, v, h, g, peak in NODES:
        mean = [sum(c) / len(c) for c in zip(*seen[i], strict=True)] or [0.0] * 4
        out[i] = (r / 1e4, v / 3e4, h / 2e3, g / 10, peak / 10, len(seen[i]) / 3, mean[0], mean[1], mean[2] / 180, reach[i], mean[3] / 2e4)
    return out


def test_features_and_geometry(spark):
    nodes, edges = spark.createDataFrame(NODES, SCHEMAS[0]), spark.createDataFrame(EDGES, SCHEMAS[1])
    f = summary_features(nodes, edges)
    want = brute()
    got = {r[0]: tuple(r[1:]) for r in f.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)
    p = {1: 0.1, 2: 1.0, 3: 0.0, 4: None}
    g = burn_geometry(f.join(spark.createDataFrame(list(p.items()), "node long, probability double"), "node"))
    for node, depth, radial, along, across in g.collect():
        if p[node] is None:
            assert (depth, radial, along, across) == (None,) * 4
            continue
        w = want[node]
        assert depth == min(4, math.ceil(p[node] * 4 + w[9] * 1.5))
        assert (radial, along, across) == pytest.approx((min(1, max(-1, (w[4] - 0.5) * 0.25)), min(5, max(0.05, 0.05 + p[node] * 1.35 + w[4] / 12 + w[1] * 0.2)), min(1, max(-1, (w[9] - 0.35) * 0.22))))


SCORE = "node long, primary double, cross_check double, physics double"


def test_review_names_the_first_and_counts_all(spark):
    rows = [(i, 0.9 if i % 2 else 0.5, 0.5, i / 100) for i in range(60)] + [(60, 0.75, 0.5, 0.0), (61, None, 0.9, 0.5), (62, 0.1, None, None)]
    r = ranker_review(spark.createDataFrame(rows, SCORE)).first()
    assert (r.primary_ok, r.cross_check_ok, r.fallback_used, r.disagreement_count, r.max_disagreement) == (True, True, False, 30, 0.4)
    assert r.disputed == ",".join(str(i) for i in range(1, 41, 2))


def test_review_falls_back(spark):
    rows = [(1, None, 0.1, 0.2), (2, None, 0.4, 0.3), (3, None, 0.3, 0.9), (4, None, 0.9, 0.95)]
    r = ranker_review(spark.createDataFrame(rows, SCORE)).first()
    assert (r.primary_ok, r.fallback_used, r.disagreement_count, r.max_disagreement, r.disputed, r.spearman_vs_physics) == (False, True, 0, 0.0, "", 0.8)


def test_review_of_too_few(spark):
    for rows in ([], [(1, 0.5, 0.1, 0.2), (2, 0.5, 0.1, 0.1)]):
        r = ranker_review(spark.createDataFrame(rows, SCORE)).collect()
        assert len(r) == 1 and r[0].spearman_vs_physics is None and r[0].disagreement_count == len(rows)
