"""Command line: python -m cellweave COMMAND MODEL... [--goal a=1] ...; one JSON object a line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import parse_goal
from .operators import kernels, states, structure
from .plans import api
from .plans.frames import Models
from .sources import tools
from .sources.text import READERS, WRITERS, format_of

GOAL = {
    "reachability": lambda m, a: api.reachability(m, a.goal, a.start),
    "quantitative": lambda m, a: api.quantitative(m, a.goal, a.start, a.max_states),
    "probability": lambda m, a: api.probability(m, a.goal, a.threshold, a.start, a.budget),
    "delay": lambda m, a: api.delay(m, a.goal, a.start),
    "scenario": lambda m, a: api.scenarios(m, a.goal, a.k, a.kind == "fastest", a.start),
    "cutsets": lambda m, a: api.cutsets(m, a.goal, a.max_size, a.start),
    "mutations": lambda m, a: api.mutations(m, a.goal, a.effect == "enable", a.start),
    "compare": lambda m, a: api.compare(m, a.goal, a.start),
    "abstract": lambda m, a: api.abstract(m, a.goal, a.start),
    "causality": lambda m, a: api.causality_graph(m, a.goal, a.start),
    "ablation": lambda m, a: api.ablation(m, a.goal, a.start, a.budget or 256, a.reps),
    "report": lambda m, a: api.validation_report(m, a.goal, a.start),
    "reduce": lambda m, a: api.reduce_model(m, a.goal[0]),
}
MODEL = {
    "info": lambda m, a: structure.info(m),
    "stats": lambda m, a: structure.stats(m),
    "validate": lambda m, a: structure.validate(m),
    "inspect": lambda m, a: structure.render_anx(m).orderBy("model_id", "line"),
    "losses": lambda m, a: structure.projection_losses(m),
    "normalize": lambda m, a: structure.render_anx(api.booleanize(m) if a.booleanize else m).orderBy("model_id", "line"),
    "assign-rates": lambda m, a: structure.assign_rates(m, a.low, a.high, a.seed),
    "scc": lambda m, a: structure.components(structure.influences(m)),
    "cycles": lambda m, a: _signed(structure.circuits(structure.influences(m)), a.sign),
    "feedback": lambda m, a: structure.feedback(structure.circuits(structure.influences(m))),
    "fixpoints": lambda m, a: states.fixpoints(m),
    "attractors": lambda m, a: api.attractors(m),
    "trap-spaces": lambda m, a: states.trap_spaces(m, a.minimal),
    "slice": lambda m, a: api.slice_model(m, a.component),
    "sweep": lambda m, a: api.sweep(m, a.metric, a.reps),
}


def _signed(found: DataFrame, sign: str) -> DataFrame:
    return found if sign == "all" else found.where(F.col("sign") == (1 if sign == "positive" else -1))


def _text_of(path: str) -> str:
    with open(path) as f:
        return f.read()


def _network(path: str, kind: str | None = None):
    """A network from one file; parameters of a MaBoSS model from the .cfg file beside it."""
    kind, name = format_of(path, kind), os.path.splitext(os.path.basename(path))[0]
    if kind == "maboss":
        beside = path[: -len(".bnd")] + ".cfg"
        return READERS[kind](_text_of(path), _text_of(beside) if os.path.exists(beside) else None, name=name)
    if kind == "zginml":
        with open(path, "rb") as f:
            return READERS[kind](f.read(), name=name)
    return READERS[kind](_text_of(path), name=name)


def export(a: argparse.Namespace) -> int:
    """MODEL [--to format] [--output file]: the model in another format, to a file or to the standard output."""
    source, target = a.model[0], a.output or (a.model[1] if len(a.model) > 1 else None)
    if not (a.to or target):
        raise ValueError("--to or --output is needed")
    text = WRITERS[format_of(target or "", a.to)](_network(source, a.format))
    if target is None:
        print(text, end="")
    else:
        with open(target, "w") as f:
            f.write(text)
    return 0


def verify(a: argparse.Namespace) -> int:
    """nusmv|storm|storm-time|maboss|fallback MODEL --goal a=1: what an external program says. 2: it is not installed."""
    kind, path = a.model
    net, goal = _network(path, a.format), parse_goal(a.goal[0])
    program = {"nusmv": "NuSMV", "storm": "storm", "storm-time": "storm", "maboss": "MaBoSS"}.get(kind)
    if kind == "fallback":
        verdict = kernels.reachability(net, net.initial, goal)["verdict"]
        out = {"verdict": verdict, "by": "static"}
        if verdict == "Inconclusive" and tools.detect("storm"):
            out = {"prob": tools.storm_probability(net, goal), "by": "storm"}
    elif program is None:
        raise ValueError(f"no tool {kind}")
    elif not tools.detect(program):
        print(json.dumps({"error": f"{program} is not installed"}))
        return 2
    elif kind == "nusmv":
        out = {"reachable": tools.nusmv_reachable(net, goal)}
    elif kind == "maboss":
        beside = path[: -len(".bnd")] + ".cfg"
        series = tools.maboss_series(_text_of(path), _text_of(beside) if os.path.exists(beside) else "", a.samples, a.max_time)
        marginal = [(t, p.get(goal[0], 0.0)) for t, p in series]
        low = kernels.quantitative(net, net.initial, goal)["prob"] or 0.0
        out = {"prob": marginal[-1][1], "binf": low, "sound": low <= marginal[-1][1] + 1e-9, "quantiles": {str(q): next((t for t, p in marginal if p >= q), None) for q in api.QUANTILES}, "cdf": marginal}
    else:
        out = {"prob": tools.storm_probability(net, goal)} if kind == "storm" else {"expected_time": tools.storm_time(net, goal)}
    print(json.dumps({"tool": kind, "goal": a.goal[0], **out}))
    return 0 if out.get("sound", True) else 1


def repo(a: argparse.Namespace, spark: SparkSession) -> int:
    """init | add MODEL [--id x] [--tag t] | list [--tag t] | get ID | rm ID | tag ID T... | search TEXT | bundle ID, in
    the folder --repo."""
    action, *rest = a.model
    held = api.Repository(spark, a.repo)
    if action == "init":
        held.init()
        return 0
    if action in ("get", "rm", "tag", "bundle") and not held.list().where(F.col("id") == rest[0]).count():
        raise KeyError(rest[0])
    if action == "add":
        net = _network(rest[0], a.format)
        held.add(a.id or os.path.splitext(os.path.basename(rest[0]))[0], WRITERS["anx"](net), a.tag)
    elif action == "list":
        show(held.search(tag=a.tag[0] if a.tag else None).select("id", "tags").orderBy("id"))
    elif action == "search":
        show(held.search(rest[0]).select("id", "tags").orderBy("id"))
    elif action == "rm":
        held.remove(rest[0])
    elif action == "tag":
        held.tag(rest[0], rest[1:])
    elif action in ("get", "bundle"):
        text = held.bundle(rest[0]) if action == "bundle" else held.list().where(F.col("id") == rest[0]).first().text
        if a.output:
            with open(a.output, "w") as f:
                f.write(text)
        else:
            print(text, end="")
    else:
        raise ValueError(f"no action {action}")
    return 0


def bench(a: argparse.Namespace, spark: SparkSession) -> int:
    """models FOLDER: the names of its models; run FOLDER: their sizes, or why one can't be read."""
    action, folder = a.model
    names = sorted(x for x in os.listdir(folder) if x.endswith((".anx", ".bnd")))
    if action == "models":
        for name in names:
            print(json.dumps({"model": name}))
    elif action == "run":
        texts = [(n, "anx", _text_of(os.path.join(folder, n))) for n in names if n.endswith(".anx")]
        show(api.sweep_texts(spark.createDataFrame(texts, "model_id string, format string, text string"), "load").select("model", "automata", "transitions", "note"))
    else:
        raise ValueError(f"no action {action}")
    return 0


def main(argv: list[str] | None = None) -> int:
    """0: answered; 1: the input is at fault."""
    p = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    p.add_argument("command", choices=sorted([*GOAL, *MODEL, "diff", "convert", "export", "verify", "repo", "bench"]))
    p.add_argument("model", nargs="+")
    p.add_argument("--goal", action="append", default=[])
    p.add_argument("--from", dest="start")
    p.add_argument("--format")
    p.add_argument("--threshold", type=float)
    p.add_argument("--budget", type=int)
    p.add_argument("--max-states", type=int, default=100_000)
    p.add_argument("--max-size", type=int, default=3)
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--kind", choices=("most-probable", "fastest"), default="most-probable")
    p.add_argument("--effect", choices=("enable", "disable"), default="disable")
    p.add_argument("--booleanize", action="store_true")
    p.add_argument("--minimal", action="store_true")
    p.add_argument("--component")
    p.add_argument("--metric", choices=("reachability", "fixpoints", "load"), default="reachability")
    p.add_argument("--low", type=float)
    p.add_argument("--high", type=float)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--sign", choices=("all", "positive", "negative"), default="all")
    p.add_argument("--reps", type=int, default=1)
    p.add_argument("--to")
    p.add_argument("-o", "--output")
    p.add_argument("--samples", type=int)
    p.add_argument("--max-time", type=float)
    p.add_argument("--repo", default=".cellweave")
    p.add_argument("--id")
    p.add_argument("--tag", action="append", default=[])
    a = p.parse_args(argv)
    try:
        if a.command in ("convert", "export"):
            return export(a)
        if a.command in [*GOAL, "verify"] and not a.goal:
            p.error("a --goal is needed")
        for g in a.goal:
            parse_goal(g)
        if a.command == "verify":
            return verify(a)
        spark = SparkSession.builder.appName("cellweave").getOrCreate()
        if a.command in ("repo", "bench"):
            return (repo if a.command == "repo" else bench)(a, spark)
        read = lambda path: Models.read(spark, path, a.format)
        if a.command == "diff":
            found = structure.diff(read(a.model[0]), read(a.model[1]))
        else:
            found = (GOAL | MODEL)[a.command](read(a.model[0]), a)
        show(found)
        return 0
    except (ValueError, KeyError, OSError) as e:
        print(json.dumps({"error": str(e)}))
        return 1


def show(found: DataFrame) -> None:
    for row in found.toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    sys.exit(main())
