"""The jobs: growing input over several runs, against plain loops; the command line."""

import json
import os
import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta, timezone

from jobs import dialogue_chain, event_jumps

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
START = datetime(2024, 1, 1)


def make_events(rng, ids, first, last):
    return [(i, START + timedelta(seconds=rng.randrange(first * 86400, last * 86400, 1777)), rng.choice((1, 1, 1, 2, 3, -4)), rng.choice("abc")) for i in ids]


def slow_jumps(rows):
    by, out = {}, {}
    for i, ts, u, kind in rows:
        if None not in (ts, u, kind):
            by.setdefault(u, []).append((ts, i, kind))
    for own in by.values():
        own.sort()
        for (a, _, x), (b, _, y) in zip(own, own[1:]):
            n, us = out.get((b.date(), x, y), (0, 0))
            out[b.date(), x, y] = (n + 1, us + round((b - a).total_seconds() * 1e6))
    return out


def jumps_of(df):
    return {(r.day, r.src, r.dst): (r.n, r.us) for r in df.collect()}


def files_under(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_event_jumps_over_growing_input(spark, tmp_path):
    rng = random.Random(6)
    source, out = f"{tmp_path}/events.parquet", f"{tmp_path}/out"
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(source)
    rows = make_events(rng, range(-20, 100), 0, 5) + [(500, None, 1, "a"), (501, START, None, "a"), (502, START, 1, None), (503, START, 7, "a"), (503, START, 7, "b")]
    add(rows)
    assert jumps_of(event_jumps.run(spark, source, out)) == slow_jumps(rows)
    # later days, an earlier one, and late events that come between two that were known
    more = make_events(rng, range(100, 130), 7, 9) + make_events(rng, range(130, 136), 2, 3) + [(600, START - timedelta(days=3), 2, "c")]
    add(more)
    before = files_under(f"{out}/jumps")
    assert jumps_of(event_jumps.run(spark, source, out)) == slow_jumps(rows + more)
    after = files_under(f"{out}/jumps")
    kept = [f for f in before if "day=2024-01-05" in f]
    assert kept and all(after[f] == before[f] for f in kept), "a day that nothing changes is left alone"
    # nothing new: nothing is written
    assert jumps_of(event_jumps.run(spark, source, out)) == slow_jumps(rows + more)
    assert files_under(f"{out}/jumps") == after
    # all at once gives the same
    assert jumps_of(event_jumps.run(spark, source, f"{tmp_path}/other")) == slow_jumps(rows + more)


def test_a_batch_again_changes_nothing(spark, tmp_path):
    """As after a failure between a batch's writes and its commit."""
    rng = random.Random(7)
    rows = make_events(rng, range(60), 0, 4)
    source, out = f"{tmp_path}/events.parquet", f"{tmp_path}/out"
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    event_jumps.run(spark, source, out)
    event_jumps.update(spark.read.parquet(source), 0, out, event_jumps.DEFAULTS)
    assert jumps_of(spark.read.schema(event_jumps.JUMPS).parquet(f"{out}/jumps")) == slow_jumps(rows)


def test_event_jumps_of_nothing_and_of_other_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none")
    assert event_jumps.run(spark, f"{tmp_path}/none", f"{tmp_path}/a").collect() == []
    rows = [("x", "k2", START, "b", 1), ("x", "k1", START, "a", 2), ("y", "k3", START, "a", 3)]
    spark.createDataFrame(rows, "who string, `key.id` string, day timestamp_ntz, what string, batch int").write.parquet(f"{tmp_path}/some")
    config = f"{tmp_path}/c.json"
    with open(config, "w") as f:
        json.dump({"user": "who", "event": "key.id", "time": "day", "type": "what"}, f, indent=1)
    got = event_jumps.run(spark, f"{tmp_path}/some", f"{tmp_path}/b", config)
    assert jumps_of(got) == {(START.date(), "a", "b"): (1, 0)}


def slow_states(rows):
    by, n = {}, Counter()
    for conv, turn, role, text in rows:
        if conv is not None:
            bare = (text or "").rstrip(" \t\n\x0b\x0c\r")
            by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "none") + ("-" if not bare else "?" if bare[-1] == "?" else ".")))
    for own in by.values():
        states = [s for *_, s in sorted(own)]
        end = "end:answered" if states[-1].startswith("assistant") else "end:open"
        n.update(zip(["start", *states], [*states, end]))
    out = {}
    for (a, b), k in n.items():
        out.setdefault(a, {})[b] = k
    p = {a: {b: k / sum(x.values()) for b, k in x.items()} for a, x in out.items()}
    chance = {a: 0.0 for a in p} | {"end:answered": 1.0, "end:open": 0.0}
    for _ in range(3000):
        chance |= {a: sum(q * chance[b] for b, q in x.items()) for a, x in p.items()}
    return {(a, b): (k, round(p[a][b], 6), round(chance[a], 6)) for (a, b), k in n.items()}


def test_dialogue_chain(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None]), rng.choice(["Why? ", "So.", "", None, "ü"])) for c in range(60) for t in range(-2, rng.randrange(1, 6))]
    rows += [(None, 1, "user", "x"), (99, 1, "user", "y"), (99, 1, "assistant", "y"), (99, 1, "user", "y")]
    # a conversation of many blocks
    rows += [(100, t, "user" if t % 2 else "assistant", "long?") for t in range(-40, 60)]
    source = f"{tmp_path}/turns"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(source)
    config = f"{tmp_path}/c.json"
    with open(config, "w") as f:
        json.dump({"turns_per_block": 7}, f)
    for _ in range(2):
        got = dialogue_chain.run(spark, source, f"{tmp_path}/out", config)
        assert {(r.src, r.dst): (r.n, r.p, r.answered) for r in got.collect()} == slow_states(rows)


def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    rows = [{"event_id": i, "ts": (START + timedelta(hours=i)).replace(tzinfo=timezone.utc), "user_id": 1, "event_type": "ab"[i % 2]} for i in range(30)]
    import pandas as pd

    pd.DataFrame(rows).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    command = [sys.executable, "-m", "jobs.event_jumps", f"{tmp_path}/events.parquet", f"{tmp_path}/out", "--config", f"{root}/jobs/event_jumps.json"]
    for seen in ("30 events of 2 days read, 2 days written", "jumps between types and days"):
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and seen in done.stderr, done.stderr[-3000:]
