"""The relational operators against the kernels, on the fixtures and on random networks side by side."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.__main__ import main
from cellweave.model import Law, Move, Network
from cellweave.operators import chains, kernels, local, solvers, states, structure
from cellweave.plans import api
from cellweave.plans.frames import Models, encode, state_text
from cellweave.sources import text
from cellweave.sources.fixtures import GOALS, NETWORKS
from tests.test_kernels import random_network


@pytest.fixture(scope="module")
def nets():
    rng = random.Random(4)
    return {**NETWORKS, **{f"r{i}": random_network(rng) for i in range(12)}}


@pytest.fixture(scope="module")
def models(spark, nets):
    parts = Models.of(spark, nets)
    return Models(*(x.repartition(2).cache() for x in (parts.automata, parts.transitions, parts.initial, parts.models)))


def texts(net, found):
    names = kernels.Space(net).names
    return sorted(", ".join(f"{a}={k}" for a, k in zip(names, s)) for s in found)


def by_model(df, col="state"):
    out = {}
    for r in df.collect():
        out.setdefault(r.model_id, []).append(r[col])
    return {k: sorted(v) for k, v in out.items()}


def test_reachable_states(spark, nets, models):
    got = by_model(states.reachable(models).join(encode(models)[0], "model_id").select("model_id", state_text().alias("state")))
    assert got == {m: texts(n, kernels.reachable(kernels.Space(n), n.initial)) for m, n in nets.items()}
    counts = {r.model_id: r.reachable_states for r in states.reachable_counts(models).collect()}
    assert counts == {m: len(x) for m, x in got.items()}


def test_large_spaces_go_by_rounds(spark, models):
    goals = spark.createDataFrame(list(GOALS), "query_id string, model_id string, automaton string, level int")
    plain = sorted(map(tuple, states.symbolic_reachability(models, goals).collect()))
    assert sorted(map(tuple, states.symbolic_reachability(models, goals, rounds=True).collect())) == plain


def test_spaces_beyond_enumeration(spark):
    names = [f"x{i:02d}" for i in range(70)]
    free = Network("free", dict.fromkeys(names, 2), {a: [Move(a, 0, 1)] for a in names}, {a: frozenset((0,)) for a in names})
    many = Models.of(spark, {"free": free, "cell": NETWORKS["cellfate"]})
    assert {r.model_id: int(r.reachable_states) for r in states.reachable_counts(many).collect()} == {"free": 2**70, "cell": 71}
    assert {r.model_id: int(r.fixpoints) for r in states.fixpoint_counts(many).collect()} == {"free": 1, "cell": 3}


def test_may_reach_and_interventions(spark, nets, models):
    got = {}
    for r in local.may_reach(models).collect():
        got.setdefault(r.model_id, set()).add((r.automaton, r.level))
    assert got == {m: kernels.may_reach(n, n.initial) for m, n in nets.items()}
    goals = spark.createDataFrame(list(GOALS), "query_id string, model_id string, automaton string, level int")
    lost = {}
    for r in local.disabling_mutations(models, goals).collect():
        lost.setdefault(r.query_id, []).append(r.target)
    for q, m, a, k in GOALS:
        assert sorted(lost.get(q, [])) == sorted(kernels.mutations(nets[m], nets[m].initial, (a, k), False))


def test_structure(nets, models):
    cycles = {m: [] for m in nets}
    for r in structure.circuits(structure.influences(models)).collect():
        cycles[r.model_id].append((r.nodes, r.sign))
    assert sorted(cycles["cellfate"]) == [("Caspase8,NFkB", 1), ("Caspase8,NFkB,RIP1", 1)] and cycles["oscillator"] == [("a,b", -1)] and cycles["p53-mdm2"] == [("Mdm2,p53", -1)]
    assert {r.model_id: r.nodes for r in structure.components(structure.influences(models)).collect()}["oscillator"] == "a,b"
    stats = {r.model_id: r for r in structure.stats(models).collect()}
    assert (stats["cellfate"].edges, stats["cellfate"].automata) == (15, 11)
    assert structure.validate(models).where("severity = 'error'").count() == 0


def test_validation_finds_faults(spark):
    bad = Network("bad", {"a": 2, "b": 2}, {"a": [Move("a", 0, 5), Move("a", 0, 1, (("x", 0),)), Move("a", 1, 1, (("b", 7),), Law.exp(-1))], "b": []})
    found = {(r.severity, r.message) for r in structure.validate(Models.of(spark, {"bad": bad})).collect()}
    assert {m for s, m in found if s == "warning"} == {"b: no transition", "a: 1 -> 1 when b=7: stays where it is"}
    assert len([m for s, m in found if s == "error"]) == 4


def test_phases_and_rates(spark, nets, models):
    wide = structure.expand_phases(models)
    for m in ("phasetype-demo", "cellfate", "r3"):
        rows = sorted(wide.transitions.where(F.col("model_id") == m).collect(), key=lambda r: r.tid)
        assert [(r.automaton, r.from_level, r.to_level, [tuple(c) for c in r.conditions], r.rate) for r in rows] == [(x.automaton, x.source, x.target, list(x.conditions), x.law.rate) for x in nets[m].expanded().transitions]
    drawn = structure.assign_rates(models, 0.1, 5.0, 3)
    assert drawn.where("rate < 0.1 OR rate > 5.0").count() == 0 and drawn.exceptAll(structure.assign_rates(models, 0.1, 5.0, 3)).count() == 0
    with pytest.raises(ValueError):
        structure.assign_rates(models, 2, 1)


def test_absorption_ways_agree(spark):
    rng = random.Random(1)
    rows = [(f"m{k}", f"s{rng.randrange(6)}", f"s{rng.randrange(8)}", rng.uniform(0.1, 3)) for k in range(4) for _ in range(30)]
    edges = spark.createDataFrame([r for r in rows if r[1] != r[2] and r[1] != "s0"], "model_id string, src string, dst string, rate double")
    goals = edges.select("model_id", F.lit("s0").alias("node")).distinct()
    one = {(r.model_id, r.node): r.prob for r in chains.absorption(edges, goals).collect()}
    two = {(r.model_id, r.node): r.prob for r in chains.absorption_by_joins(edges, goals, 1e-10).collect()}
    assert all(abs(one[k] - two.get(k, 0.0)) < 1e-7 for k in one)
    old = chains.SMALL
    chains.SMALL = 2
    try:
        import pandas as pd

        rows = pd.concat([edges.toPandas().assign(goal=None), pd.DataFrame({"model_id": [f"m{k}" for k in range(4)], "src": "s0", "dst": None, "rate": None, "goal": True})])
        alone = {(r.model_id, r.node): r.prob for r in chains._solve(rows).itertuples()}
    finally:
        chains.SMALL = old
    assert alone.keys() == one.keys() and all(abs(one[k] - alone[k]) < 1e-9 for k in one)


def test_large_chains_take_other_ways(spark, monkeypatch):
    """The same chains as matrices, by sweeps, and by joins; times are only where a goal is certain."""
    rng = random.Random(4)
    rows = [("m0", f"s{i}", f"s{j}", rng.uniform(1, 2) if j < i else 0.05) for i in range(1, 6) for j in {rng.randrange(6), i - 1} if i != j]
    rows += [("m1", "a", "b", 1.0), ("m1", "b", "a", 0.1), ("m1", "a", "s0", 1.0), ("m1", "b", "stop", 1.0), ("m1", "x", "y", 1.0)]
    edges = spark.createDataFrame(rows, "model_id string, src string, dst string, rate double")
    goals = spark.createDataFrame([("m0", "s0"), ("m1", "s0")], "model_id string, node string")
    stop = spark.createDataFrame([("m1", "stop")], "model_id string, node string")
    answer = lambda **x: {(r.model_id, r.node): (r.prob, r.mean_time) for r in chains.absorption(edges, goals, stop, **x).collect()}
    exact = answer()
    assert exact["m1", "a"][0] == pytest.approx(11 / 21) and exact["m1", "a"][1] is None and exact["m1", "x"] == (0.0, None) and exact["m0", "s4"][1] > 0
    monkeypatch.setattr(chains, "SMALL", 1)
    monkeypatch.setattr(chains, "DENSE", 1)
    import pandas as pd

    ends = [("m0", "s0", None, None, True), ("m1", "s0", None, None, True), ("m1", "stop", None, None, False)]
    swept = {(r.model_id, r.node): (r.prob, r.mean_time) for r in chains._solve(pd.DataFrame([(*r, None) for r in rows] + ends, columns=["model_id", "src", "dst", "rate", "goal"])).itertuples()}
    for found in (answer(largest=3, tolerance=1e-7), swept):
        assert found.keys() == exact.keys()
        for k, (p, t) in exact.items():
            assert found[k][0] == pytest.approx(p, abs=1e-6) and (t is None or found[k][1] == pytest.approx(t, rel=1e-5))


def test_rare_exits_are_right_or_null(spark, monkeypatch):
    """Two states that hardly ever leave: a step changes next to nothing long before the answer is reached."""
    import pandas as pd

    rows = [("sure", "a", "b", 1.0), ("sure", "b", "a", 1.0), ("sure", "b", "goal", 1e-10)]
    rows += [("even", "a", "b", 1.0), ("even", "b", "a", 1.0), ("even", "b", "goal", 1e-10), ("even", "b", "lost", 3e-10)]
    edges = spark.createDataFrame(rows, "model_id string, src string, dst string, rate double")
    goals = spark.createDataFrame([("sure", "goal"), ("even", "goal")], "model_id string, node string")
    exact = {(r.model_id, r.node): (r.prob, r.mean_time) for r in chains.absorption(edges, goals).collect()}
    for node in "ab":
        assert exact["sure", node][0] == 1.0 and exact["sure", node][1] == pytest.approx(2e10, rel=1e-6) and exact["even", node] == (pytest.approx(0.25, abs=1e-9), None)
    joined = {(r.model_id, r.node): r.prob for r in chains.absorption_by_joins(edges, goals, max_rounds=10).collect()}
    assert joined["sure", "a"] == joined["sure", "b"] == 1.0 and joined["even", "a"] is None and joined["even", "lost"] == 0.0
    assert {r.mean_time for r in chains.hitting_times_by_joins(edges.where("model_id = 'sure'"), goals.where("model_id = 'sure'"), max_rounds=10).collect()} == {None, 0.0}
    monkeypatch.setattr(chains, "SMALL", 0)
    monkeypatch.setattr(chains, "DENSE", 0)
    monkeypatch.setattr(solvers, "WORK", 5_000)
    swept = chains._solve(pd.DataFrame([(*r, None) for r in rows] + [(m, "goal", None, None, True) for m in ("sure", "even")], columns=["model_id", "src", "dst", "rate", "goal"])).set_index(["model_id", "node"])
    assert swept.prob["sure", "a"] == 1.0 and math.isnan(swept.mean_time["sure", "a"]) and math.isnan(swept.prob["even", "a"])


def test_elimination_against_fractions():
    from fractions import Fraction

    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 7)
        src, dst, rate = zip(*[(i, j, rng.choice((1.0, 1e-8, 3.0, 1e-12))) for i in range(n) for j in [*range(n + 2)] if rng.random() < 0.6 and i != j] or [(0, n, 1.0)])
        goal = np.arange(n + 2) == n
        h, _ = solvers.absorbed(np.array(src), np.array(dst), np.array(rate), goal, dense=100)
        p = {}
        for i, j, r in zip(src, dst, rate):
            p.setdefault(i, {})[j] = Fraction(r)
        # Gauss on fractions, over the nodes that can reach the goal
        can = {n}
        while more := {i for i in p if i not in can and any(j in can for j in p[i])}:
            can |= more
        free = sorted(can - {n})
        m = [[Fraction(int(i == j)) - p[i].get(j, Fraction(0)) / sum(p[i].values()) for j in free] + [p[i].get(n, Fraction(0)) / sum(p[i].values())] for i in free]
        for k in range(len(free)):
            pivot = next(r for r in range(k, len(free)) if m[r][k])
            m[k], m[pivot] = m[pivot], m[k]
            m[k] = [x / m[k][k] for x in m[k]]
            for r in range(len(free)):
                if r != k and m[r][k]:
                    m[r] = [x - m[r][k] * y for x, y in zip(m[r], m[k])]
        for k, i in enumerate(free):
            assert h[i] == pytest.approx(float(m[k][-1]), rel=1e-12)


def test_bracket_holds_the_probability(spark, models):
    """For every fixture's goals: bounds that hold the chain's probability, and get tighter."""
    asked = spark.createDataFrame([g for g in GOALS if g[1] in ("p53-mdm2", "cellfate", "multivalued-demo")], "query_id string, model_id string, automaton string, level int")
    got = {}
    for r in states.bracket(models, asked, (0, 2, 8, 24), 1e-6).collect():
        got.setdefault(r.query_id, []).append((r.budget, r.lower, r.upper))
    exact = {q: kernels.ctmc(NETWORKS[m], NETWORKS[m].initial, (a, k))[0] for q, m, a, k in GOALS if q in got}
    assert len(got) == asked.count()
    for q, rows in got.items():
        rows.sort()
        assert all(low - 1e-9 <= exact[q] <= high + 1e-9 for _, low, high in rows)
        assert all(x[1] <= y[1] + 1e-12 and x[2] >= y[2] - 1e-12 for x, y in zip(rows, rows[1:])) and rows[-1][2] - rows[-1][1] < 0.3


def test_api(spark, models, tmp_path):
    cell = Models.of(spark, {"cellfate": NETWORKS["cellfate"]})
    row = api.quantitative(cell, ["Apoptosis=1"]).first()
    assert row.prob == pytest.approx(0.5) and row.prob_exact and row.earliest_delay == 4
    assert api.probability(cell, ["Apoptosis=1"], 0.4, budget=4).first().meets_threshold
    assert api.reachability(cell, ["Survival=1"], "TNF=0,Survival=0,NFkB=0,RIP1=0").first().verdict == "Unreachable"
    assert api.reachability(cell, ["Survival=1"], "TNF=0").first().verdict == "Reachable"
    found = api.ablation(cell, ["Apoptosis=1", "Necrosis=1"]).collect()
    assert len(found) == 6 and all(r.agrees and r.time_ms > 0 for r in found) and {r.strategy for r in found} == {"chain", "diagrams", "bracket"}
    assert api.compare(cell, ["MPT=1"]).first().sound and len(api.scenarios(cell, ["Survival=1"], 2).collect()) == 2
    assert api.abstract(cell, ["Apoptosis=1"]).first().cone_size == 7 and api.cutsets(cell, ["Survival=1"], 1).count() == 2
    assert api.causality_graph(cell, ["Survival=1"]).count() > 3 and api.delay(cell, ["Survival=1"]).first().delay == 3
    assert max(api.sweep(models).collect(), key=lambda r: r.automata).model == "cellfate"
    swept = api.sweep_texts(spark.createDataFrame([("good", "anx", "automaton a [2]\na: 0 -> 1\ninit a=0"), ("bad", "anx", "nonsense")], "model_id string, format string, text string")).collect()
    assert {(r.model, r.automata, r.local_states, r.value, bool(r.note)) for r in swept} == {("good", 1, 2, 2, False), ("bad", None, None, None, True)}
    graph = api.causality_graph(cell, ["Apoptosis=1"]).collect()
    assert not any(r.truncated for r in graph) and {r.solution for r in graph if r.objective == "Apoptosis=1"} == {0}
    hit = spark.createDataFrame([("cellfate", "Necrosis=1", 7.5, ["ROS", "TNF"])], "model_id string, goal string, q25 double, active array<string>")
    report = api.validation_report(cell, ["Necrosis=1"], hitting=hit).first()
    assert report.oracle == "maboss" and report.delay_gap == 7.5 - report.t_delay and 0 < report.scenario_overlap < 1
    report = api.validation_report(cell, ["Necrosis=1"]).first()
    assert report.oracle == "none" and report.delay_gap is None
    assert report.sound and report.exact == pytest.approx(0.234375) and report.t_delay == 4
    assert '"objective": "NFkB=1"' in api.causality_texts(cell, ["Survival=1"], "json").first().text
    assert '"Survival=1" -> "Survival=1/0";' in api.causality_texts(cell, ["Survival=1"], "dot").first().text
    assert "needs NFkB=1" in api.causality_texts(cell, ["Survival=1"]).first().text
    repo = api.Repository(spark, str(tmp_path)).init()
    from cellweave.sources.fixtures import TEXTS

    repo.add("cell", TEXTS["cellfate"], ["b"])
    repo.add("cell", TEXTS["cellfate"], ["a"])
    repo.add("p", TEXTS["p53-mdm2"])
    repo.tag("p", ["z"])
    assert [(r.id, r.tags) for r in repo.list().orderBy("id").collect()] == [("cell", ["a", "b"]), ("p", ["z"])]
    assert repo.search("CEL").count() == 1 and repo.search(tag="z").count() == 1 and "# tags: a,b" in repo.bundle("cell")
    assert {r.model_id: r.automata for r in structure.info(repo.models()).collect()} == {"cell": 11, "p": 3}
    repo.remove("p")
    assert repo.list().count() == 1


def test_reading_files(spark, tmp_path):
    from cellweave.sources.text import write_an, write_anx

    for m in ("cellfate", "p53-mdm2"):
        (tmp_path / f"{m}.anx").write_text(write_anx(NETWORKS[m]))
        (tmp_path / f"{m}.an").write_text(write_an(NETWORKS[m]))
    for kind in ("anx", "an"):
        found = Models.read(spark, f"{tmp_path}/*.{kind}", kind)
        assert {r.model_id: r.transitions for r in structure.info(found).collect()} == {"cellfate": 27, "p53-mdm2": 7}
    (tmp_path / "m.bnd").write_text("node A { logic = B; rate_up = @logic ? $u : 0; }\nnode B { logic = !A; }")
    (tmp_path / "m.cfg").write_text("$u = 2.5; A.istate = 0;")
    found = Models.read(spark, f"{tmp_path}/m.bnd")
    assert sorted((r.automaton, r.to_level, r.rate) for r in found.transitions.collect()) == [("A", 0, 1.0), ("A", 1, 2.5), ("B", 0, 1.0), ("B", 1, 1.0)]
    assert [(r.automaton, r.level) for r in found.initial.collect()] == [("A", 0)]
    (tmp_path / "m.cfg").unlink()
    assert {r.rate for r in Models.read(spark, f"{tmp_path}/m.bnd").transitions.collect()} == {1.0}
    (tmp_path / "s.sbml").write_text(__import__("cellweave.sources.sbml", fromlist=["x"]).write_sbml(NETWORKS["oscillator"]))
    assert structure.info(Models.read(spark, f"{tmp_path}/s.sbml")).first().transitions == 4


def test_command_line(spark, tmp_path, capsys):
    import json

    from cellweave.__main__ import main
    from cellweave.sources.text import write_anx

    path = str(tmp_path / "cellfate.anx")
    (tmp_path / "cellfate.anx").write_text(write_anx(NETWORKS["cellfate"]))
    for args in (["info"], ["stats"], ["feedback"], ["trap-spaces", "--minimal"], ["attractors"], ["quantitative", "--goal", "Apoptosis=1"], ["reduce", "--goal", "Survival=1"], ["inspect"]):
        assert main([args[0], path, *args[1:]]) == 0
        lines = capsys.readouterr().out.splitlines()
        assert lines and all(json.loads(x)["model_id"] == "cellfate" for x in lines)
    assert main(["convert", path, str(tmp_path / "c.an")]) == 0 and (tmp_path / "c.an").exists()
    assert main(["slice", path, "--component", "nobody"]) == 1


def test_cache(spark, models, tmp_path):
    calls = []

    def answer(m):
        calls.append(1)
        return structure.info(m)

    for _ in range(2):
        assert api.cached(spark, str(tmp_path), "info", models, answer).count() == 18
    assert len(calls) == 1


def test_commands_beside_questions(spark, capsys, tmp_path):
    cell = tmp_path / "cellfate.anx"
    cell.write_text(text.write_anx(NETWORKS["cellfate"]))
    call = lambda *args: (main(list(args)), [x for x in capsys.readouterr().out.splitlines() if x.strip()])
    for ending in ("bnet", "ginml", "sbml", "booleannet", "an", "dot"):
        assert call("export", str(cell), "-o", f"{tmp_path}/out.{ending}")[0] == 0 and (tmp_path / f"out.{ending}").read_text()
    assert call("export", str(cell), "--to", "prism")[1][0] == "ctmc" and call("export", str(cell))[0] == 1
    repo = ("--repo", f"{tmp_path}/repo")
    assert call("repo", "init", *repo)[0] == 0 and call("repo", "add", str(cell), "--tag", "death", *repo)[0] == 0 and call("repo", "tag", "cellfate", "cell", *repo)[0] == 0
    assert call("repo", "list", "--tag", "cell", *repo)[1] == ['{"id":"cellfate","tags":["cell","death"]}'] and call("repo", "search", "nothing", *repo)[1] == []
    assert call("repo", "get", "cellfate", *repo)[1][0].startswith("#") and call("repo", "bundle", "cellfate", "-o", f"{tmp_path}/b.anx", *repo)[0] == 0
    assert call("repo", "rm", "cellfate", *repo)[0] == 0 and call("repo", "get", "cellfate", *repo)[0] == 1
    (tmp_path / "bad.anx").write_text("nonsense")
    assert len(call("bench", "models", str(tmp_path))[1]) == 3
    assert any('"note":' in x for x in call("bench", "run", str(tmp_path))[1])
    assert call("verify", "nusmv", str(cell), "--goal", "Apoptosis=1")[0] == 2 and "Reachable" in call("verify", "fallback", str(cell), "--goal", "Apoptosis=1")[1][0]
    assert call("cycles", str(cell), "--sign", "negative")[1] == [] and len(call("cycles", str(cell), "--sign", "positive")[1]) == 2


def test_the_simulator_runs_where_it_is_installed(spark, tmp_path, monkeypatch):
    """A stand-in program that writes a trajectory, found by its name on the path."""
    program = tmp_path / "MaBoSS"
    lines = "Time\\tTH\\tErrorTH\\tH\\tHD=0\\tState\\tProba\\tErrorProba\\n0.0\\t0\\t0\\t0\\t1\\t<nil>\\t1.0\\t0\\n1.0\\t0\\t0\\t0\\t1\\tA\\t0.3\\t0\\tA -- B\\t0.2\\t0\\n"
    program.write_text(f'#!/bin/sh\nwhile [ "$1" != "-o" ]; do shift; done\nprintf "{lines}" > "$2_probtraj.csv"\n')
    program.chmod(0o755)
    texts = spark.createDataFrame([("m", "node A { logic = A; }", "A.istate = 0;")], "model_id string, text string, extra string")
    assert api.hitting_times(texts, ["A=1"], program="no such program").collect() == []
    row = api.hitting_times(texts, ["A=1"], samples=10, max_time=2.0, program=str(program)).first()
    assert (row.prob, row.q25, row.quantiles[0.9], row.active) == (0.5, 1.0, None, ["A"])
