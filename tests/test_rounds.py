"""Operators by rounds of joins, against plain loops and the kernels, on random graphs and networks side by side."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.model import Move, Network
from cellweave.operators import graphs, kernels, local, runs, states, structure
from cellweave.plans.frames import Models, encode
from cellweave.sources.fixtures import GOALS, NETWORKS
from tests.test_kernels import random_network


@pytest.fixture(scope="module")
def nets():
    rng = random.Random(14)
    return {**{n: NETWORKS[n] for n in ("p53-mdm2", "multivalued-demo", "cellfate")}, **{f"r{i}": random_network(rng) for i in range(10)}}


@pytest.fixture(scope="module")
def models(spark, nets):
    parts = Models.of(spark, nets)
    return Models(*(x.repartition(2).cache() for x in (parts.automata, parts.transitions, parts.initial, parts.models)))


@pytest.fixture(scope="module")
def goals(spark, nets):
    rows = [(f"{m} {a}={k}", m, a, k) for m, net in nets.items() for a in net.automata for k in range(net.levels[a])]
    return spark.createDataFrame(rows, "query_id string, model_id string, automaton string, level int").cache()


def test_strong_components(spark):
    rng = random.Random(2)
    rows = [("random", rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    rows += [("ring", i, (i + 1) % 40) for i in range(40)] + [("chain", i, i + 1) for i in range(30)]
    rows += [("two", 1, 2), ("two", 2, 1), ("two", 2, 3), ("two", 3, 4), ("two", 4, 3), ("two", 5, 5), ("two", 1, 2), ("two", None, 1), ("two", 7, None)]
    edges = spark.createDataFrame(rows, "model_id string, src long, dst long").repartition(3)
    want, end = {}, {}
    for m in {r[0] for r in rows}:
        own = [(a, b) for x, a, b in rows if x == m and None not in (a, b)]
        after = {}
        for a, b in own:
            after.setdefault(a, []).append(b)
        parts = kernels.components(sorted({*itertools.chain(*own)}), lambda v: after.get(v, ()))
        for c in parts:
            want |= {(m, v): min(c) for v in c}
            if all(b in c for a in c for b in after.get(a, ())):
                end |= {(m, v): min(c) for v in c}
    assert {(r.model_id, r.node): r.comp for r in graphs.strong_components(edges).collect()} == want
    assert {(r.model_id, r.node): r.comp for r in graphs.terminal(edges).collect()} == end
    assert graphs.strong_components(edges.limit(0)).collect() == []


def test_attractors_by_rounds(spark, nets, models):
    got = {}
    for r in states.attractors_by_rounds(models).collect():
        got.setdefault((r.model_id, r.attractor), set()).add(r.state)
    for m, net in nets.items():
        names = kernels.Space(net).names
        want = sorted(sorted(", ".join(f"{a}={k}" for a, k in zip(names, s)) for s in x) for x in kernels.attractors(net))
        assert sorted(sorted(x) for (n, _), x in got.items() if n == m) == want
    assert {(r.model_id, r.state) for r in states.attractors_by_rounds(models, cap=10).collect() if r.attractor is None} >= {("cellfate", None)}


def test_shortest_runs(spark, nets, models, goals):
    found = {r.query_id: r for r in runs.shortest_runs(models, goals).collect()}
    spaces = {r.model_id: r.digits for r in encode(models)[0].collect()}
    for q, m, a, k in (tuple(r) for r in goals.collect()):
        net = nets[m]
        space = kernels.Space(net)
        depth, todo = {s: 0 for s in space.starts(net.initial)}, list(space.starts(net.initial))
        for s in todo:
            for _, to in space.enabled(s):
                if to not in depth:
                    depth[to] = depth[s] + 1
                    todo.append(to)
        hits = [d for s, d in depth.items() if s[space.place[a]] == k]
        if not hits:
            assert q not in found
            continue
        r = found[q]
        assert r.steps == min(hits) == len(r.run)
        # the run itself leads from a start to the goal
        at = tuple((r.start // d.stride) % d.levels for d in spaces[m])
        assert depth[at] == 0
        for tid in r.run:
            move = net.transitions[tid]
            at = next(to for own, to in space.enabled(at) if own is move or own == move)
        assert at[space.place[a]] == k


def test_likeliest_runs(spark):
    rng = random.Random(3)
    rows = []
    for m in range(8):
        for a in range(6):
            out = [b for b in range(6) if rng.random() < 0.5] or [0]
            weight = [rng.choice((1, 1, 2, 5)) for _ in out]
            rows += [(f"m{m}", f"s{a}", f"s{b}", w / sum(weight)) for b, w in zip(out, weight)]
    rows += [("loop", "s0", "s1", 1.0), ("loop", "s1", "s0", 1.0), ("few", "s0", "s5", 0.25), ("few", "s0", "s1", 0.75), ("few", "s1", "s2", 1.0), ("there", "s5", "s0", 1.0)]
    jumps = spark.createDataFrame(rows, "model_id string, src string, dst string, p double")
    names = sorted({r[0] for r in rows})
    start = spark.createDataFrame([(m, "s5" if m == "there" else "s0") for m in names], "model_id string, node string")
    goal = spark.createDataFrame([(m, "s5") for m in names], "model_id string, node string")
    got = {}
    for r in runs.likeliest_runs(jumps, start, goal, 4).collect():
        got.setdefault(r.model_id, {})[r.rank] = (r.cost, tuple(r.run))
    for m in names:
        after = {}
        for x, a, b, p in rows:
            if x == m:
                after.setdefault(a, []).append((b, math.floor(-math.log(p) * runs.UNIT + 0.5)))
        hope = {"s5"}
        while more := {a for a in after if a not in hope and any(b in hope for b, _ in after[a])}:
            hope |= more
        todo, best = [(0, ("s5" if m == "there" else "s0",))], []
        while todo and len(best) < 4:
            cost, run = heapq.heappop(todo)
            if run[-1] == "s5":
                best.append((cost, run))
                continue
            for b, c in after.get(run[-1], ()):
                if b in hope and run[-1] in hope:
                    heapq.heappush(todo, (cost + c, (*run, b)))
        assert [x for _, x in sorted(got.get(m, {}).items())] == best, m


def test_cutsets_by_levels(spark, nets, models, goals):
    got = {}
    for r in local.cutsets_by_levels(models, goals, 3).collect():
        got.setdefault(r.query_id, set()).add(frozenset(r.members.split(",")))
    for q, m, a, k in (tuple(r) for r in goals.collect()):
        net = nets[m]
        if m == "cellfate" and (a, k) not in {(x, y) for _, n, x, y in GOALS if n == m}:
            continue
        first = {(b, j) for b in net.automata for j in net.admitted(net.initial, b)}
        want = []
        if (a, k) in kernels.may_reach(net, net.initial):
            every = [(b, j) for b in net.automata for j in range(net.levels[b]) if (b, j) not in first and (b, j) != (a, k)]
            for size in (1, 2, 3):
                for own in itertools.combinations(every, size):
                    if not any(x <= set(own) for x in want) and (a, k) not in kernels.may_reach(net, net.initial, frozenset(own)):
                        want.append(set(own))
        assert got.get(q, set()) == {frozenset(f"{b}={j}" for b, j in x) for x in want}


def test_starts_by_unranking(spark, nets, models):
    spaces, _ = encode(models)
    got = {}
    for r in states.start_states(models, spaces).collect():
        got.setdefault(r.model_id, []).append(r.sid)
    digits = {r.model_id: r.digits for r in spaces.collect()}
    for m, net in nets.items():
        want = sorted(sum(k * d.stride for k, d in zip(s, digits[m])) for s in kernels.Space(net).starts(net.initial))
        assert sorted(got[m]) == want
    free = Network("free", dict.fromkeys([f"x{k:02d}" for k in range(21)], 2), {}, {"x00": frozenset((1,))})
    one = Models.of(spark, {"free": free})
    n, distinct, odd = states.start_states(one, encode(one)[0]).agg(F.count(F.lit(1)), F.countDistinct("sid"), F.sum(F.col("sid") % 2)).first()
    assert (n, distinct, odd) == (1 << 20, 1 << 20, 1 << 20)


def test_nothing_is_lost_without_a_word(spark):
    """Long chains of levels, and spaces of more states than numbers."""
    steps = 70
    chain = Models.of(spark, {"chain": Network("chain", {"a": steps}, {"a": [Move("a", k, k + 1) for k in range(steps - 1)]}, {"a": frozenset((0,))})})
    assert local.local_paths(chain).count() == steps * (steps - 1) // 2
    assert local.local_paths(chain, max_length=2).count() == (steps - 1) + (steps - 2)
    names = [f"x{k:02d}" for k in range(65)]
    wide = Network("wide", dict.fromkeys(names, 2), {"x00": [Move("x00", 0, 1)]}, {a: frozenset((0,)) for a in names})
    small = Network("small", {"a": 2}, {"a": [Move("a", 0, 1)]}, {"a": frozenset((0,))})
    both = Models.of(spark, {"wide": wide, "small": small})
    assert {r.model_id: r.reachable_states for r in states.reachable_counts(both, rounds=True).collect()} == {"wide": None, "small": 2}
    asked = spark.createDataFrame([("w", "wide", "x00", 1), ("s", "small", "a", 1), ("n", "small", "a", 5)], "query_id string, model_id string, automaton string, level int")
    assert {r.query_id: (r.reachable, r.reachable_states) for r in states.symbolic_reachability(both, asked, rounds=True).collect()} == {"w": (None, None), "s": (True, 2), "n": (False, 2)}


def test_kernels_deal_models_out(spark):
    """One goal over many models is many tasks, and so are the models that are too large for numbers."""
    from cellweave.plans import api
    from cellweave.plans.frames import kernel

    nets = {f"m{k}": Network("", {"a": 2}, {"a": [Move("a", 0, 1)]}, {"a": frozenset((0,))}) for k in range(40)}
    models = Models.of(spark, nets)
    answers = {"one goal": api.quantitative(models, ["a=1"]), "sweep": api.sweep(models), "same text": kernel(models.models.select(F.lit("x").alias("same"), "text"), "n long", lambda net, q: [(1,)])}
    for name, rows in answers.items():
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) <= 12, (name, sizes)


def test_circuits_by_rounds_equal_the_search(spark):
    rng = random.Random(6)
    rows = [(f"m{k}", f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice((1, -1, 0))) for k in range(12) for _ in range(k + 4)]
    rows += [("line", "a", "b", 1), ("line", "b", "c", -1), ("loop", "a", "a", -1), ("none", None, "a", 1), *rows[:5]]
    edges = spark.createDataFrame([(*r, 0) for r in rows], "model_id string, src string, dst string, sign int, comp int")
    got = sorted(map(tuple, graphs.circuits(edges).collect()))
    assert got == sorted(map(tuple, structure.circuits(edges.dropna()).collect())) and ("loop", "a", -1, False) in got and len(got) > 30
    assert graphs.circuits(edges.limit(0)).collect() == []


def test_circuits_by_rounds_say_where_they_stopped(spark):
    names = "abcdefg"
    full = [("big", a, b, 1) for a in names for b in names if a != b]
    edges = spark.createDataFrame([*full, ("small", "a", "b", 1), ("small", "b", "a", -1)], "model_id string, src string, dst string, sign int")
    whole = graphs.circuits(edges).collect()
    # every set of two or more nodes of a full graph is a circuit
    assert sorted(r.nodes for r in whole if r.model_id == "big") == sorted(",".join(c) for n in range(2, 8) for c in itertools.combinations(names, n))
    part = graphs.circuits(edges, most=10).collect()
    assert {(r.nodes, r.sign, r.truncated) for r in part if r.model_id == "small"} == {("a,b", -1, False)}
    big = [r for r in part if r.model_id == "big"]
    assert big and all(r.truncated for r in big) and len(big) < 120
