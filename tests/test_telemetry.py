"""Operators on a busy object: the same results whatever the time buckets and blocks are."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from apsidal.operators import encounters as ops

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def telemetry(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 else (None if i % 7 == 0 else 2), start + timedelta(minutes=(i * i * 37) % 40000), None if i % 11 == 0 else float(i * 31 % 97)) for i in range(900)]
    return spark.createDataFrame(rows, "event_id long, object_id long, ts timestamp, value double").cache()


def ordered(rows):
    return sorted(rows, key=lambda r: (r.object_id is not None, r.object_id or 0, r.ts, r.event_id))


def by_object(rows):
    out = {}
    for r in ordered(rows):
        out.setdefault(r.object_id, []).append(r)
    return out


@pytest.mark.parametrize("width", [3_600_000_000, DAY, 1000 * DAY])
def test_sessions(telemetry, width):
    want = []
    for o, rows in by_object(telemetry.collect()).items():
        runs = []
        for r in rows:
            if runs and (r.ts - runs[-1][-1]).total_seconds() <= 1800:
                runs[-1].append(r.ts)
            else:
                runs.append([r.ts])
        want += [(o, k + 1, len(x), int((x[-1] - x[0]).total_seconds())) for k, x in enumerate(runs)]
    got = [tuple(r) for r in ops.sessions(telemetry, 1800, width).select("object_id", "session", "n", "seconds").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20


@pytest.mark.parametrize("width", [3_600_000_000, DAY, 1000 * DAY])
def test_as_of(telemetry, width):
    left, right = telemetry.where("event_id % 2 = 0"), telemetry.where("event_id % 2 = 1")
    want, seen = {}, {}
    for r in sorted(telemetry.collect(), key=lambda r: (r.ts, r.event_id % 2 == 0, r.event_id)):
        if r.event_id % 2 == 0:
            want[r.event_id] = seen.get(r.object_id)
        elif r.value is not None:
            seen[r.object_id] = r.value
    got = {r.event_id: r.last_value for r in ops.as_of(left, right, "object_id", "ts", "value", "event_id", width).collect()}
    assert got == want and any(v is None for v in want.values())


@pytest.mark.parametrize(("width", "block"), [(3_600_000_000, 64), (DAY, 50), (1000 * DAY, 50_000)])
def test_rolling_score(telemetry, width, block):
    import numpy as np

    want = {}
    for rows in by_object(telemetry.collect()).values():
        for i, r in enumerate(rows):
            seen = np.array([x.value for x in rows[max(0, i - 49) : i + 1] if x.value is not None])
            flat = len(seen) < 2 or seen.std() < 1e-6
            want[r.event_id] = 0.0 if flat else (None if r.value is None else (r.value - seen.mean()) / seen.std())
    got = {r.event_id: r.z for r in ops.rolling_score(telemetry, 50, block, width).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 2e-6) for k, v in want.items())


def test_empty(telemetry):
    none = telemetry.where(F.lit(False))
    assert ops.sessions(none).isEmpty() and ops.rolling_score(none).isEmpty() and ops.as_of(none, telemetry, "object_id", "ts", "value", "event_id").isEmpty()
