"""Published and analytic values, and agreement with an independent brute force on random networks."""

import random

import pytest

from cellweave.model import Law, Move, Network
from cellweave.operators import kernels as k
from cellweave.sources.fixtures import NETWORKS


def at(net):
    return NETWORKS[net], NETWORKS[net].initial


def test_published_probabilities():
    for net, goal, want in (("p53-mdm2", ("p53", 1), 1.0), ("cellfate", ("Apoptosis", 1), 0.5), ("cellfate", ("Necrosis", 1), 0.234375), ("cellfate", ("Survival", 1), 0.5), ("cellfate", ("MPT", 1), 0.28125), ("multivalued-demo", ("g", 2), 1.0)):
        assert k.ctmc(*at(net), goal)[0] == pytest.approx(want, abs=1e-9)
    assert k.ctmc(NETWORKS["phasetype-demo"].expanded(), {"g": frozenset((0,))}, ("g", 1))[0] == pytest.approx(2 / 3)
    assert k.ctmc(*at("p53-mdm2"), ("Mdm2", 1))[1] == pytest.approx(2.25)
    assert k.ctmc(*at("multivalued-demo"), ("g", 2))[1] == pytest.approx(3.4375)
    assert k.ctmc(NETWORKS["cellfate"], NETWORKS["cellfate"].initial, ("Apoptosis", 1), whole=True)[0] == pytest.approx(0.5)


def test_analytic_values():
    race = Network("race", {"g": 3}, {"g": [Move("g", 0, 1), Move("g", 0, 2, law=Law.exp(3))]}, {"g": frozenset((0,))})
    assert k.ctmc(race, race.initial, ("g", 1))[0] == pytest.approx(1 / 4)
    cycle = Network("cycle", {"a": 4}, {"a": [Move("a", 0, 1), Move("a", 0, 3), Move("a", 1, 0), Move("a", 1, 2)]}, {"a": frozenset((0,))})
    assert k.ctmc(cycle, cycle.initial, ("a", 2))[0] == pytest.approx(1 / 3)
    both = Network("both", {"a": 2, "b": 2}, {"a": [Move("a", 0, 1, (("b", 0),))], "b": [Move("b", 0, 1, law=Law.exp(2))]}, {"a": frozenset((0,)), "b": frozenset((0,))})
    assert k.ctmc(both, both.initial, ("a", 1))[0] == pytest.approx(1 / 3)
    erlang = Network("erlang", {"g": 2}, {"g": [Move("g", 0, 1, law=Law.erlang(3, 3))]}, {"g": frozenset((0,))})
    assert k.ctmc(erlang.expanded(), erlang.initial, ("g", 1))[1] == pytest.approx(1.0)


def test_structure_goldens():
    assert len(k.reachable(k.Space(NETWORKS["cellfate"]), NETWORKS["cellfate"].initial)) == 71
    assert [len(x) for x in k.attractors(NETWORKS["cellfate"])] == [1, 1, 1]
    assert [len(x) for x in k.attractors(NETWORKS["oscillator"])] == [4]
    assert sorted(len(x) for x in k.attractors(NETWORKS["p53-mdm2"])) == [1, 4]
    for goal, size, states in ((("Apoptosis", 1), 7, 12), (("Necrosis", 1), 8, 32), (("Survival", 1), 6, 10)):
        net = NETWORKS["cellfate"]
        assert len(net.cone(goal[0])) == size
        assert k.refine(net, net.initial, goal)["verdict"] == "Reachable"
    assert len(k.refine(*at("cellfate"), ("Apoptosis", 1))["visible"]) == 7


def test_delays_and_paths():
    for net, goal, want in (("p53-mdm2", ("Mdm2", 1), 2.25), ("multivalued-demo", ("g", 2), 2.5), ("cellfate", ("Apoptosis", 1), 4), ("cellfate", ("Necrosis", 1), 4), ("cellfate", ("Survival", 1), 3), ("delay-chain", ("a", 1), 1), ("delay-chain", ("b", 1), 2), ("delay-chain", ("c", 1), 3)):
        assert k.earliest_delay(*at(net), goal) == pytest.approx(want)
    best = k.top_scenarios(*at("multivalued-demo"), ("g", 2), 1)[0]
    assert best[0] == pytest.approx(8 / 15) and best[1] == pytest.approx(2.066667, abs=1e-6) and len(best[2]) == 3
    assert k.top_scenarios(*at("phasetype-demo"), ("g", 1), 3) == [(pytest.approx(2 / 3), pytest.approx(0.4166667), ["g: 0 -> 1"])]


def test_brackets():
    for budget, want in ((1, (0.25, 0.75)), (2, (0.3125, 0.625)), (4, (0.40625, 0.5)), (8, (0.5, 0.5)), (256, (0.5, 0.5))):
        assert k.bracket(*at("cellfate"), ("Apoptosis", 1), budget) == pytest.approx(want)
    low, high = k.bracket(*at("multivalued-demo"), ("g", 2), 256)
    assert low == pytest.approx(0.994199769547, abs=1e-9) and high == 1.0


def test_interventions():
    one = lambda goal: [c for c in k.cutsets(*at("cellfate"), goal) if len(c) == 1]
    assert one(("Apoptosis", 1)) == [("Caspase3=1",), ("Caspase8=1",), ("FADD=1",)]
    assert one(("Necrosis", 1)) == [("MPT=1",), ("RIP1=1",), ("ROS=1",)]
    assert one(("Survival", 1)) == [("NFkB=1",), ("RIP1=1",)]
    assert k.cutsets(*at("p53-mdm2"), ("Mdm2", 1)) == [("p53=1",)]
    assert k.mutations(*at("p53-mdm2"), ("Mdm2", 1), False) == ["DNAdam=0", "Mdm2=0", "p53=0"]


def random_network(rng):
    names = "abc"[: rng.randrange(2, 4)]
    levels = {a: rng.randrange(2, 4) for a in names}
    moves = {}
    for a in names:
        moves[a] = []
        for _ in range(rng.randrange(4)):
            i, j = rng.sample(range(levels[a]), 2)
            guard = tuple((b, rng.randrange(levels[b])) for b in names if b != a and rng.random() < 0.4)
            moves[a].append(Move(a, i, j, guard, Law.exp(round(rng.uniform(0.5, 4), 2))))
    return Network("random", levels, moves, {a: frozenset((0,)) for a in names})


def test_random_networks_are_consistent():
    rng = random.Random(8)
    for _ in range(150):
        net = random_network(rng)
        goal = (net.automata[0], rng.randrange(1, net.levels[net.automata[0]]))
        exact, _ = k.exact_reach(net, net.initial, goal)
        found = k.reachability(net, net.initial, goal)
        assert found["ua"] == exact and (found["oa"] or not exact)
        p = k.ctmc(net, net.initial, goal)[0]
        assert (p > 1e-12) == exact
        low, high = k.bracket(net, net.initial, goal, 64, 3000)
        assert low - 1e-9 <= p <= high + 1e-9
        assert k.anytime_bound(net, net.initial, goal, 16, 3000) <= p + 1e-9
        assert (k.witness_bound(net, net.initial, goal) or 0.0) <= p + 1e-9
        assert k.ctmc(net, net.initial, goal, whole=True)[0] == pytest.approx(p, abs=1e-8)
        assert (k.refine(net, net.initial, goal)["verdict"] == "Reachable") == exact


def test_bound_of_a_run():
    net = NETWORKS["delay-chain"]
    assert k.witness_bound(net, net.initial, ("c", 1)) == pytest.approx(1 / 27)
    assert k.witness_bound(net, net.initial, ("c", 0)) == 1.0
