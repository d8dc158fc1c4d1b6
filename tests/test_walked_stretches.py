"""Fixed-age sessions: stretches that are walked through and stretches that go by pointers."""

import datetime
import random

import pytest

from clickloom.operators import sessionize

TIMEOUT = 1800
BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def brute(rows):
    spans = []
    for key in {k for k, _ in rows}:
        start, no = None, 0
        for at in sorted(t for k, t in rows if k == key):
            if start is None or at >= start + TIMEOUT:
                start, no = at, no + 1
                spans.append([key, no, start, at, 0])
            spans[-1][3:] = [at, spans[-1][4] + 1]
    return {tuple(s) for s in spans}


@pytest.mark.parametrize("events,slices", [(10_000, 1_000), (60, 1_000), (10_000, 3), (0, 0)])
def test_walked_and_pointed_stretches_agree(spark, monkeypatch, events, slices):
    monkeypatch.setattr(sessionize, "WALKED_EVENTS", events)
    monkeypatch.setattr(sessionize, "WALKED_SLICES", slices)
    sent, real = [], sessionize._next_starts
    monkeypatch.setattr(sessionize, "_next_starts", lambda *a: sent.append(1) or real(*a))
    rng = random.Random(8)
    rows = [(k, rng.randrange(0, 20) * 900 + rng.randrange(0, 90) * 10) for k in ("a", "b") for _ in range(200 if k == "a" else 25)]
    rows += [("c", 0), ("c", 0), ("c", TIMEOUT), ("c", TIMEOUT), ("c", 2 * TIMEOUT - 1), ("d", 5), ("e", 0), ("e", 1799), ("e", 1800)]
    df = spark.createDataFrame([(k, BEGIN + datetime.timedelta(seconds=t)) for k, t in rows], "actor_key string, received_at timestamp")
    found = sessionize.session_spans(sessionize.sessionize(df, timeout_seconds=TIMEOUT, mode="fixed")).selectExpr(
        "actor_key", "session_no", "unix_seconds(started_at) s", "unix_seconds(ended_at) e", "events").collect()
    zero = int(BEGIN.timestamp())
    assert {(r[0], r[1], r.s - zero, r.e - zero, r.events) for r in found} == brute(rows)
    # short stretches need no pointers
    assert bool(sent) == (events < 10_000 or slices < 1_000)
