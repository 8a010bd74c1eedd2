"""Chains derived from events, against a plain loop."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from cellweave.plans import derive


def slow(rows, per_user):
    by = defaultdict(list)
    for i, ts, u, kind in rows:
        if ts is not None:
            by[u].append((ts, i, kind))
    jumps, stay = defaultdict(int), defaultdict(float)
    for u, own in by.items():
        own.sort()
        for (a, _, x), (b, _, y) in zip(own, own[1:]):
            m = f"u{u}" if per_user else "events"
            jumps[m, x, y] += 1
            stay[m, x] += (b - a).total_seconds()
    return {k: n / stay[k[:2]] for k, n in jumps.items() if stay[k[:2]] > 0}


def test_event_chain(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        # a busy user, ties in time, days without events, a user with one event
        rows.append((i, start + timedelta(seconds=rng.randrange(0, 9 * 86400, 997)), rng.choice((1, 1, 1, 2, 3)), rng.choice("abc")))
    rows += [(900, start, 7, "a"), (901, None, 1, "b"), (902, start + timedelta(days=30), 2, "c"), (903, start, 8, "a"), (904, start, 8, "b")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(3)
    for per_user in (False, True):
        got = {(r.model_id, r.src, r.dst): r.rate for r in derive.event_chain(events, per_user).collect()}
        want = slow(rows, per_user)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert derive.event_chain(events.limit(0)).collect() == []
