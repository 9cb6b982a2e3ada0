"""Streams with state: any cut of the rows into batches ends in the same result as the batch form."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest

from apsidal.streaming import state
from apsidal.streaming.telemetry import drained

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def stream_of(spark, path, batches, schema):
    """One file a batch, read one at a time in the order of their times."""
    os.makedirs(path)
    for n, rows in enumerate(batches):
        file = f"{path}/{n:04d}.parquet"
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), file)
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def cuts(rows, seed):
    """One batch, many batches in order, many in disorder with some rows twice."""
    rng = random.Random(seed)
    mixed = rows + rng.sample(rows, len(rows) // 5)
    rng.shuffle(mixed)
    return [[rows], [rows[i : i + 7] for i in range(0, len(rows), 7)], [mixed[i : i + 11] for i in range(0, len(mixed), 11)]]


def test_histories(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1 + i % 3 if i % 9 else 4, i, START + timedelta(minutes=rng.randrange(90)), float(rng.randrange(100))) for i in range(120)]
    want = {}
    for o in {r[0] for r in rows}:
        last = sorted((r[2], r[1], r[3]) for r in rows if r[0] == o)[-20:]
        values = [v for _, _, v in last]
        want[o] = (len(last), int(last[-1][0].timestamp() * 1e6), round(sum(values) / len(values), 9), ([0.0] * 8 + values)[-8:])
    for n, batches in enumerate(cuts(rows, 2)):
        s = stream_of(spark, f"{tmp_path}/h{n}", batches, "object_id long, event_id long, ts timestamp, value double")
        got = {r.object_id: (r.n, r.last_us, round(r.mean, 9), list(r.recent)) for r in drained(state.histories(s, keep=20), "update", ["object_id"]).collect()}
        assert got == want


def test_histories_expire(spark, tmp_path):
    day = timedelta(days=1)
    batches = [[(1, 1, START, 5.0), (2, 2, START, 7.0)], [(2, 3, START + 10 * day, 8.0)], [(2, 4, START + 11 * day, 9.0)], [(1, 5, START + 12 * day, 6.0)]]
    s = stream_of(spark, f"{tmp_path}/e", batches, "object_id long, event_id long, ts timestamp, value double")
    got = {r.object_id: (r.n, r.mean) for r in drained(state.histories(s, expiry_ms=3 * 86_400_000, late="1 day"), "update", ["object_id"]).collect()}
    assert got[1] == (1, 6.0)  # forgotten after three days, begun anew
    assert got[2][0] <= 3


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """The same checkpoint, stopped between batches: the history goes on."""
    schema = "object_id long, event_id long, ts timestamp, value double"
    out = []
    for part in range(2):
        batches = [[(1, 10 * part + i, START + timedelta(hours=10 * part + i), float(i))] for i in range(3)]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for n, rows in enumerate(batches):
            file = f"{tmp_path}/in/{part}{n}.parquet"
            pq.write_table(spark.createDataFrame(rows, schema).toArrow(), file)
            os.utime(file, (1_700_000_000 + 10 * part + n,) * 2)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = state.histories(s).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.n for r in out] == [1, 2, 3, 4, 5, 6]


def test_settlements(spark, tmp_path):
    rng = random.Random(4)
    at = lambda h: START + timedelta(hours=h)
    predictions = sorted([(i, i % 4, at(rng.randrange(0, 300)), float(i)) for i in range(60)], key=lambda r: r[2])
    actuals = sorted([(i % 4, at(rng.randrange(0, 310)), float(rng.randrange(50))) for i in range(40)] + [(0, at(400), 1.0)], key=lambda r: r[1])
    predictions.append((99, 1, at(400), 5.0))
    want = {}
    for i, o, due, value in predictions:
        near = sorted((t, v) for p, t, v in actuals if p == o and due <= t <= due + timedelta(hours=12))
        if near or due < at(400 - 48 - 12):
            want[i] = (o, value - near[0][1] if near else None)
    for n, size in enumerate((1000, 9)):
        p = stream_of(spark, f"{tmp_path}/p{n}", [predictions[i : i + size] for i in range(0, len(predictions), size)], "prediction_id long, object_id long, due timestamp, predicted double")
        a = stream_of(spark, f"{tmp_path}/a{n}", [actuals[i : i + size] for i in range(0, len(actuals), size)], "object_id long, ts timestamp, actual double")
        got = {r.prediction_id: (r.object_id, r.residual) for r in state.earliest(drained(state.settlements(p, a), "append")).collect()}
        assert got == want


def test_replacement(spark, tmp_path):
    frames = [("fragment", 1, "a"), ("fragment", 1, "b"), ("forecast", 1, "x"), ("fragment", 2, "c"), ("forecast", 3, None), ("other", 2, "y"), ("other", 2, None), ("fragment", 4, "d"), ("fragment", 4, "e"), ("empty", 1, None)]
    want = {"fragment": (4, ["d", "e"]), "forecast": (3, []), "other": (2, ["y"]), "empty": (1, [])}
    orders = [[frames], [[f] for f in frames], [[f] for f in reversed(frames)], [frames[:6], frames[3:], frames, frames[:2]]]
    for n, batches in enumerate(orders):
        s = stream_of(spark, f"{tmp_path}/r{n}", batches, "source string, version long, item string")
        got = {r.source: (r.version, list(r["items"])) for r in drained(state.replaced_by_source(s), "update", ["source"]).collect()}
        assert got == want


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, 1, at(0)), (2, 2, at(100))], [(1, 3, at(39)), (1, 4, at(40)), (2, 5, at(41)), (2, 6, at(300))], [(1, 7, at(239)), (2, 8, at(240)), (1, 9, at(500))], [(1, 10, at(0))]]
    s = stream_of(spark, f"{tmp_path}/l", batches, "object_id long, event_id long, ts timestamp")
    rows = drained(state.marked_late(s, "1 hour"), "append").collect()
    assert len(rows) == 10 and sorted(r.event_id for r in rows if r.late) == [3, 7, 10]


@pytest.mark.parametrize("size", [1000, 13])
def test_closed_sessions(spark, tmp_path, size):
    rng = random.Random(6)
    rows = sorted([(i % 5, i, START + timedelta(minutes=rng.randrange(60 * 24 * 12))) for i in range(200)], key=lambda r: r[2])
    mark = max(r[2] for r in rows) - timedelta(days=2)
    times, want = defaultdict(list), set()
    for o, _, t in rows:
        times[o].append(t)
    for o, ts in times.items():
        run = [ts[0]]
        for t in [*ts[1:], ts[-1] + timedelta(days=99)]:
            if t - run[-1] > timedelta(hours=8):  # a row at the very expiry goes on
                if run[-1] + timedelta(hours=8) <= mark:
                    want.add((o, int(run[0].timestamp() * 1e6), int((run[-1] + timedelta(hours=8)).timestamp() * 1e6), len(run)))
                run = []
            run.append(t)
    s = stream_of(spark, f"{tmp_path}/s", [rows[i : i + size] for i in range(0, len(rows), size)], "object_id long, event_id long, ts timestamp")
    assert {tuple(r) for r in drained(state.closed_sessions(s), "append").collect()} == want
