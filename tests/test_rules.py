"""Rules that queries and their SQL share, against plain Python written from the rule."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from apsidal.functions import encounters, objects
from apsidal.operators import encounters as joins
from apsidal.operators import graph, statistics
from apsidal.sources import catalogue


def disk_chance(miss, sigma, radius):
    """The integral over the disk by exact slices: 4000 strips across, each an error-function difference."""
    n, total = 4000, 0.0
    for i in range(n):
        th = math.pi * (i + 0.5) / n
        x, half = radius * math.cos(th), radius * math.sin(th)
        density = math.exp(-((x - miss) ** 2) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
        total += density * math.erf(half / (sigma * math.sqrt(2))) * half * math.pi / n
    return total


def test_isotropic_probability(spark):
    cases = [(m, 1.0, r) for m in (0.0, 0.3, 1.0, 2.5, 5.0, 8.0, 15.0) for r in (0.01, 0.1, 0.5, 1.0, 2.0, 5.0)] + [(0.1, 0.02, 0.05), (0.2, 0.5, 0.5), (19.0, 1.0, 20.0), (21.0, 1.0, 20.0), (3.0, 1.0, 25.0)]
    df = spark.createDataFrame(cases, "miss double, sigma double, radius double").withColumn("pc", encounters.isotropic_pc(F.col("miss"), F.col("sigma"), F.col("radius")))
    for r in df.collect():
        assert r.pc == pytest.approx(disk_chance(r.miss, r.sigma, r.radius), rel=1e-6), r
    far = spark.createDataFrame([(1e6, 1.0, 1.0), (0.0, 1.0, 1e4), (1e4, 1.0, 1e4), (50.0, 1.0, 40.0)], "miss double, sigma double, radius double").select(encounters.isotropic_pc(F.col("miss"), F.col("sigma"), F.col("radius")).alias("pc")).collect()
    assert far[0].pc == 0 and far[1].pc == 1 and abs(far[2].pc - 0.5) < 1e-3 and far[3].pc < 1e-20


def seats(sizes, budget):
    total = sum(sizes.values())
    quota = {k: max(1, budget * n / total) for k, n in sizes.items()}
    got = {k: min(math.floor(q), sizes[k]) for k, q in quota.items()}
    order = sorted(sizes, key=lambda k: (-(quota[k] - math.floor(quota[k])), k))
    left = budget - sum(got.values())
    while left > 0 and any(got[k] < sizes[k] for k in order):
        for k in order:
            if left > 0 and got[k] < sizes[k]:
                got[k] += 1
                left -= 1
    while sum(got.values()) > budget:
        got[min(sorted(got), key=lambda k: (-got[k], k))] -= 1
    return got


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 7, 20, 60, 107, 108, 500])
@pytest.mark.parametrize("sizes", [{"a": 100, "b": 2, "c": 2, "d": 2, "e": 2}, {"a": 3, "b": 50, "c": 50, "d": 1, "e": 4}, {"x": 5}])
def test_largest_remainder(spark, sizes, budget):
    got = statistics.largest_remainder(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), budget).collect()
    assert {r.stratum: r.seats for r in got} == seats(sizes, budget)


def onward(pairs, events, alert, limit):
    """Nearest first, smaller ids first; away from the events where they reach, anywhere where they do not."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, queue = {e: 0 for e in events}, deque(events)
    while queue:
        n = queue.popleft()
        for m in near.get(n, ()):
            if m not in hops:
                hops[m] = hops[n] + 1
                queue.append(m)
    a, b = alert
    if a in hops and b in hops:
        far = max(hops[a], hops[b])
        starts, blocked = [n for n in (a, b) if hops[n] == far], [n for n in (a, b) if hops[n] < far]
    else:
        starts, blocked, hops = [a, b], [], None
    seen, out, layer, distance = set(starts) | set(blocked), [], starts, 0
    while layer and len(out) < limit:
        distance += 1
        layer = sorted({m for n in layer for m in near.get(n, ()) if m not in seen and m >= 0 and (hops is None or hops[m] > hops[n])})
        seen |= set(layer)
        out += [(m, distance) for m in layer]
    return out[:limit]


@pytest.mark.parametrize("limit", [2, 5, 50])
def test_downstream(spark, limit):
    pairs = [(-1, 1), (-1, 0), (0, 1), (1, 2), (2, 4), (1, 3), (4, 5), (3, 5), (5, 6), (6, 7), (4, 30), (4, 31), (4, 32), (8, 9), (9, 10), (10, 11), (9, 12), (12, 8), (20, 21)]
    pairs += [(2, 100 + i) for i in range(200)] + [(10, 400 + i) for i in range(200)] + [(400, 700)]
    alerts = [p for p in pairs if p[0] >= 0]
    e = spark.createDataFrame(pairs, "a long, b long")
    hops = graph.breadth_first(e, spark.createDataFrame([(-1,)], "node long"))
    reached = {r.node: r.hops for r in hops.collect()}
    starts = []
    for a, b in alerts:
        far = max((reached.get(n, 0) for n in (a, b)))
        starts += [(f"{a}-{b}", n) for n in (a, b) if reached.get(n) is None or reached[n] == far]
    got = {}
    for r in graph.downstream(e, hops, spark.createDataFrame(starts, "key string, node long"), limit).collect():
        got.setdefault(r.key, []).append((r.node, r.distance))
    for a, b in alerts:
        want = onward(pairs, [-1], (a, b), limit)
        assert sorted(got.get(f"{a}-{b}", []), key=lambda x: (x[1], x[0])) == want, (a, b)
    assert onward(pairs, [-1], (1, 3), 50)[0] == (5, 1) and (10, 1) in onward(pairs, [-1], (8, 9), 50)


@pytest.mark.parametrize("limit", [2, 5, 50])
def test_downstream_counts(spark, limit):
    """As long as the lists are, of every pair, repeats kept: hubs, pairs with two starts, unreached parts, paths that lead to a hub."""
    rng = np.random.default_rng(limit)
    pairs = [(-1, 1), (-1, 0), (0, 1), (1, 2), (2, 4), (1, 3), (4, 5), (3, 5), (5, 6), (6, 7), (4, 30), (4, 31), (4, 32), (8, 9), (9, 10), (10, 11), (9, 12), (12, 8), (20, 21)]
    pairs += [(2, 100 + i) for i in range(200)] + [(10, 400 + i) for i in range(200)] + [(400, 700)] + [(1000 + i, 1001 + i) for i in range(9)] + [(1009, 1100 + i) for i in range(60)] + [(-2, 1000)]
    pairs += [(-3, 2000), (2000, 2001), (2000, 2002), (2001, 2002), (2001, 2003), (2002, 2003), (2002, 2004)] + [(2001, 2100 + i) for i in range(30)] + [(2002, 2120 + i) for i in range(30)]
    pairs += [(5000 + int(a), 5000 + int(b)) for a, b in rng.integers(0, 120, (130, 2)) if a < b] + [(-4, 5003), (-4, 5050)]
    pairs = sorted(set(pairs))
    alerts = [p for p in pairs if p[0] >= 0]
    e = spark.createDataFrame(pairs * 2, "a long, b long")
    ends = spark.createDataFrame([(f"{a}-{b}-{i}", a, b) for a, b in alerts for i in range(2)] + [(f"{b}-{a}-2", b, a) for a, b in alerts], "name string, one long, two long")
    got = graph.downstream_counts(e, spark.createDataFrame([(-1,), (-2,), (-3,), (-4,)], "node long"), ends, limit).collect()
    want = {p: len(onward(pairs, [-1, -2, -3, -4], p, limit)) for p in alerts}
    assert len(got) == 3 * len(alerts) and {(r.name, r.n) for r in got} == {(r.name, want.get((r.one, r.two), want.get((r.two, r.one)))) for r in got}
    assert set(range(min(limit, 4))) | {limit} <= set(want.values())


def test_counts_hand_on_no_lists_of_hubs(spark, monkeypatch):
    """Nodes next to a hub are counted by what the search says of it: no list is made or kept for them."""
    pairs = [(-1, 10_000 + f) for f in range(40)] + [(10_000 + f, s) for f in range(40) for s in range(f % 5, 20, 5)] + [(s, 100 + p) for s in range(20) for p in range(s, 400, 4)]
    kept, cut = [], graph.checkpoint

    def watched(df):
        out = cut(df)
        kept.extend(r.n for c in ("reach", "few") if c in out.columns for r in out.selectExpr(f"sum(size({c})) AS n").collect())
        return out

    monkeypatch.setattr(graph, "checkpoint", watched)
    ends = spark.createDataFrame([p for p in pairs if p[0] >= 0], "one long, two long")
    got = graph.downstream_counts(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(-1,)], "node long"), ends).collect()
    assert {(r.one >= 10_000, r.n) for r in got} == {(True, 50), (False, 0)}
    assert not any(kept)


def test_the_layout_is_not_dealt_again(spark, monkeypatch):
    """A hub's neighbours take several rows, and a join on the node keeps the layout's tasks."""
    monkeypatch.setattr(graph, "NEIGHBOURS_A_ROW", 16)
    near = graph.packed(spark.range(100).selectExpr("0L AS a", "id + 1 AS b"))
    assert sorted(len(r.bs) for r in near.where("a = 0").collect()) == [4] + [16] * 6
    front = spark.range(50).selectExpr("id AS node").hint("shuffle_hash")
    joined = front.join(near, front["node"] == near["a"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_element_names(spark):
    lines = ["1 00005U lone", "0 VANGUARD ", "1 T0001U a", "2 x", "# note", "1 t0001U b  ", "0 TWO", "0 THREE", "1 I0001U bad", "1     7U c", "1 1A001U bad"]
    rows = [("f", i * 3000, x) for i, x in enumerate(lines)] + [("g", 1, "1 00005U other")]
    got = {r.norad_id: (r.name, r.line1) for r in catalogue.element_names(spark.createDataFrame(rows, "file string, line_no long, line string")).collect()}
    assert got == {5: ("", "1 00005U other"), 270001: ("VANGUARD", "1 t0001U b"), 7: ("THREE", "1     7U c")}


def test_owner_labels_and_operators(spark):
    want = {"GER": "Germany", "ORB": "ORBCOMM", "SKOR": "South Korea", "ARGN": "Argentina", "ESRO": "ESA", "O3B": "SES", "USBZ": "United States/Brazil", "ZZZ": "ZZZ", "TBD": "Unknown", "": "Unknown", "UNK": "Unknown"}
    df = spark.createDataFrame([(k,) for k in want], "code string").select("code", objects.owner_label(F.col("code")).alias("label"))
    assert {r.code: r.label for r in df.collect()} == want
    own = [(r"\bMYSAT\b", "Mine", ()), *objects.OPERATORS]
    row = spark.createDataFrame([("MYSAT 4", None)], "name string, code string").select(objects.operator(F.col("name"), F.col("code"), own).alias("mine"), objects.operator(F.col("name"), F.col("code")).alias("none")).first()
    assert row.mine == "Mine" and row.none is None


def test_quantiles_of_values_that_differ_a_little_when_computed_again(spark):
    """Sums in another order of their rows end in other last bits; the bounds of a part must come from the values ranked."""

    def shaken(batches):
        for batch in batches:
            batch["v"] += np.random.default_rng().random(len(batch)) * 1e-9
            yield batch

    rows = spark.range(4000).selectExpr("id % 40 AS k", "CAST(id DIV 40 AS DOUBLE) AS v").repartition(4).mapInPandas(shaken, "k long, v double")
    got = statistics.histogram_quantiles(rows, ["k"], "v", [0.25, 0.5]).collect()
    assert len(got) == 40 and all(r.n == 100 and abs(r.q0 - 24.75) < 1e-6 and abs(r.q1 - 49.5) < 1e-6 for r in got)


def test_exposure_rounds_as_its_sql(spark):
    """Sums next to a half of the ninth digit: places follow it, so it has to come from the form that the SQL has."""
    ninth = lambda x: math.floor(x * 1e9 + 0.5)
    sums = [s for k in range(1, 4000) for s in [-math.log1p(-(k + 0.5) * 1e-9)] if ninth(1 - math.exp(-s)) != ninth(-math.expm1(-s))]
    rows = [(i, i, -1 - i, s, 1.0, 1.0) for i, s in enumerate(sums)]
    df = spark.createDataFrame(rows, "alert_id long, sat1 long, sat2 long, pc double, miss_km double, tca_h double")
    got = {r.sat: r.aggregate_pc for r in joins.exposure(df, F.lit(1), F.lit(1.0)).where("sat >= 0").collect()}
    assert len(sums) > 100 and got == {i: ninth(1 - math.exp(-s)) / 1e9 for i, s in enumerate(sums)}


def test_nearest_is_one_row_a_node(spark):
    """A path: every node's list in one row, cut at one more than the limit."""
    steps = [(i, i + d) for i in range(10) for d in (-1, 1) if 0 <= i + d < 10]
    got = {r.start: [tuple(x) for x in r.reach] for r in graph.nearest(spark.createDataFrame(steps, "a long, b long"), 3).collect()}
    assert got == {i: sorted((abs(i - j), j) for j in range(10) if j != i)[:4] for i in range(10)}


def test_components_of_a_long_path_in_few_rounds(spark, monkeypatch):
    ids = [int(i) for i in np.random.default_rng(5).permutation(120)]
    path = [*zip(ids, ids[1:], strict=False), (5000, 5001), (5001, 5000), (7, 7)]
    cuts, cut = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: cuts.append(1) or cut(df))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, 0), 5000: 5000, 5001: 5000}
    assert len(cuts) <= 30  # labels that pass on from node to node take 80


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def test_tasks_of_repeated_edges_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 100)
    edges = spark.range(4000).selectExpr("id % 2000 AS a", "id % 2000 + 1 AS b")
    both = graph.both_ways(edges)
    assert both.rdd.getNumPartitions() == 80
    assert sorted(map(tuple, both.collect())) == sorted({(a, b) for i in range(2000) for a, b in ((i, i + 1), (i + 1, i))})
