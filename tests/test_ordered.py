"""Neighbours and places within a key's order, against plain Python; small blocks and one key with most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from apsidal.operators.ordered import arc_spans, placed, with_neighbours
from apsidal.sources.catalogue import element_sets


def rows(n=700):
    pick = random.Random(5)
    out = [(None if i % 29 == 0 else (1 if i % 3 else i % 11), pick.randrange(50), i, pick.random()) for i in range(n)]
    pick.shuffle(out)
    return out


@pytest.mark.parametrize(("block", "reach"), [(3, 7), (7, 2), (64, 5), (50_000, 1)])
def test_neighbours_for_any_block(spark, block, reach):
    data = rows()
    df = spark.createDataFrame(data, "k long, t long, i long, v double")
    back = lambda w: {"far": F.lag("i", reach).over(w), "held": F.count(F.lit(1)).over(w.rowsBetween(-reach, 0))}
    got = {r.i: (r.far, r.held) for r in with_neighbours(df, ["k"], ["t", "i"], back, reach, block).collect()}
    by, want = defaultdict(list), {}
    for k, t, i, _ in data:
        by[k].append((t, i))
    for held in by.values():
        held.sort()
        for at, (_, i) in enumerate(held):
            want[i] = (held[at - reach][1] if at >= reach else None, min(at, reach) + 1)
    assert got == want and len(got) == len(data)


@pytest.mark.parametrize("block", [4, 50_000])
def test_places_of_all_keys(spark, block):
    data = rows()
    got = {r.i: (r.place, r.of) for r in placed(spark.createDataFrame(data, "k long, t long, i long, v double"), ["k"], ["t", "i"], block).collect()}
    by, want = defaultdict(list), {}
    for k, t, i, _ in data:
        by[k].append((t, i))
    for held in by.values():
        for at, (_, i) in enumerate(sorted(held)):
            want[i] = (at, len(held))
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, t long, a double")
    assert placed(none, ["k"], ["t"]).isEmpty() and arc_spans(none, "k", "a").isEmpty()
    assert with_neighbours(none, ["k"], ["t"], lambda w: {"x": F.lag("t").over(w)}, 1).isEmpty()


def test_arcs(spark):
    data = [(1, 350.0), (1, 10.0), (1, 20.0), (1, 20.0), (2, 90.0), (3, 0.0), (3, 180.0), (4, None), (None, 5.0), (None, 6.5)]
    got = {r.k: (r.span_deg, r.last_deg) for r in arc_spans(spark.createDataFrame(data, "k long, a double"), "k", "a", 2).collect()}
    assert got == {1: (30.0, 20.0), 2: (0.0, 90.0), 3: (180.0, 0.0), None: (1.5, 6.5)}


def test_triples_over_block_ends(spark, monkeypatch):
    import apsidal.operators.ordered as ordered

    monkeypatch.setattr(ordered.with_neighbours, "__defaults__", (2,))
    lines = [("f", 1, "0 A"), ("f", 2, ""), ("f", 3, " 1 00007U"), ("f", 4, "2 x"), ("f", 5, "1 00008U"), ("f", 6, "2 y"), ("g", 1, "0 B"), ("g", 2, "1 00009U"), ("h", 1, "2 z"), ("h", 2, "0 C"), ("h", 3, "1 x0001U"), ("h", 4, "2 w"), ("h", 5, None)]
    got = sorted(map(tuple, element_sets(spark.createDataFrame(lines, "file string, line_no long, line string")).collect()))
    assert got == [("f", 1, "A", 7, "1 00007U", "2 x"), ("h", 2, "C", 0, "1 x0001U", "2 w")]
