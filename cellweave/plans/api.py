"""One function for each question a user asks; models come as frames, answers go as frames."""

from __future__ import annotations

import hashlib
import json
import math
import time
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Network, parse_context, parse_goal
from ..operators import diagrams, kernels, states, structure
from ..sources import tools
from ..sources.text import READERS
from .frames import Models, kernel, dealt


def reduce_model(models: Models, goal: str) -> DataFrame:
    """Transitions' texts of the models without what the goal does not depend on."""
    return structure.transition_texts(_cone_part(models, parse_goal(goal)[0]))


def slice_model(models: Models, component: str) -> DataFrame:
    if not models.automata.where(F.col("automaton") == component).limit(1).count():
        raise ValueError(f"no automaton {component}")
    return structure.transition_texts(_cone_part(models, component))


def _cone_part(models: Models, automaton: str) -> Models:
    goals = models.models.select(F.col("model_id").alias("query_id"), "model_id", F.lit(automaton).alias("automaton"))
    keep = structure.cones(models, goals).select("model_id", F.col("node").alias("automaton"))
    return structure.restrict(models, keep)


def booleanize(models: Models) -> Models:
    """The models themselves where all automata have two levels at most, else an error."""
    if bad := models.automata.where("levels > 2").limit(1).collect():
        raise ValueError(f"{bad[0].model_id}: {bad[0].automaton} has more than two levels")
    return models


def ask(models: Models, goals: list[str], schema: str, answer, start: str | None = None) -> DataFrame:
    """Every goal put to every model that has its automaton; start overrides the models' initial contexts.

    answer(net, context, goal, model_id, goal's text) gives rows of schema.
    """
    spark = models.models.sparkSession
    asked = spark.createDataFrame([(g, parse_goal(g)[0]) for g in goals], "goal string, automaton string")
    rows = models.models.select("model_id", "text").join(models.automata.select("model_id", "automaton"), "model_id").join(F.broadcast(asked), "automaton").select("goal", "model_id", "text")
    context = parse_context(start)
    return kernel(rows, schema, lambda net, q: answer(net, context or net.initial, parse_goal(q["goal"]), q["model_id"], q["goal"]))


def reachability(models: Models, goals: list[str], start: str | None = None) -> DataFrame:
    schema = "model_id string, goal string, oa boolean, ua boolean, verdict string, witness array<string>, assignment array<string>"
    return ask(models, goals, schema, lambda net, ctx, g, m, t: [(m, t, *kernels.reachability(net, ctx, g).values())], start)


def quantitative(models: Models, goals: list[str], start: str | None = None, max_states: int = 100_000) -> DataFrame:
    schema = "model_id string, goal string, prob double, prob_exact boolean, earliest_delay double, mean_time double, scenario array<string>"
    return ask(models, goals, schema, lambda net, ctx, g, m, t: [(m, t, *kernels.quantitative(net, ctx, g, max_states).values())], start)


def probability(models: Models, goals: list[str], threshold: float | None = None, start: str | None = None, budget: int | None = None) -> DataFrame:
    """Exact where it can be, or a bracket where a budget is given, with the decision against a threshold: null where
    the bracket leaves it open."""

    def answer(net, ctx, g, m, t):
        if budget:
            low, high = kernels.bracket(net, ctx, g, budget)
        else:
            found = kernels.quantitative(net, ctx, g)
            low = high = found["prob"]
            if not found["prob_exact"]:
                low, high = low or 0.0, 1.0
        meets = None if threshold is None else True if low >= threshold else False if high < threshold else None
        return [(m, t, low, high, high - low <= 1e-9, meets)]

    return ask(models, goals, "model_id string, goal string, lower double, upper double, exact boolean, meets_threshold boolean", answer, start)


def scenarios(models: Models, goals: list[str], k: int = 5, fastest: bool = False, start: str | None = None) -> DataFrame:
    schema = "model_id string, goal string, rank int, probability double, delay double, transitions array<string>"
    return ask(models, goals, schema, lambda net, ctx, g, m, t: [(m, t, i, *x) for i, x in enumerate(kernels.top_scenarios(net, ctx, g, k, fastest), 1)], start)


def delay(models: Models, goals: list[str], start: str | None = None) -> DataFrame:
    """On the network as given; quantitative() has it on the expanded one."""
    return ask(models, goals, "model_id string, goal string, delay double", lambda net, ctx, g, m, t: [(m, t, kernels.earliest_delay(net, ctx, g))], start)


def cutsets(models: Models, goals: list[str], max_size: int = 3, start: str | None = None) -> DataFrame:
    return ask(models, goals, "model_id string, goal string, members array<string>", lambda net, ctx, g, m, t: [(m, t, list(c)) for c in kernels.cutsets(net, ctx, g, max_size)], start)


def mutations(models: Models, goals: list[str], enable: bool = False, start: str | None = None) -> DataFrame:
    return ask(models, goals, "model_id string, goal string, target string, makes_reachable boolean", lambda net, ctx, g, m, t: [(m, t, x, enable) for x in kernels.mutations(net, ctx, g, enable)], start)


def abstract(models: Models, goals: list[str], start: str | None = None) -> DataFrame:
    schema = "model_id string, goal string, verdict string, visible array<string>, rounds int, cone_size int"
    return ask(models, goals, schema, lambda net, ctx, g, m, t: [(m, t, *kernels.refine(net, ctx, g).values())], start)


def compare(models: Models, goals: list[str], start: str | None = None) -> DataFrame:
    """Over-approximation, search and lower bound side by side, with whole-network reachability as the exact answer."""

    def answer(net, ctx, g, m, t):
        found, exact = kernels.reachability(net, ctx, g), kernels.exact_reach(net, ctx, g)[0]
        low = kernels.anytime_bound(net, ctx, g)
        return [(m, t, found["oa"], found["ua"], exact, low, (not found["ua"] or found["oa"]) and (exact is None or exact == found["ua"]))]

    return ask(models, goals, "model_id string, goal string, oa boolean, ua boolean, exact boolean, lower double, sound boolean", answer, start)


def causality_graph(models: Models, goals: list[str], start: str | None = None) -> DataFrame:
    """A row a solution: its objective, moves, required local states and own delay. truncated: the objective has more
    solutions than are listed. An objective without a solution, which can't be met, has one row with solution -1."""

    def answer(net, ctx, g, m, t):
        for (a, k), found in kernels.causality(net, ctx, g).items():
            for number, (source, path) in enumerate(found):
                yield m, t, f"{a}={k}", number, source, [x.text() for x in path], sorted({f"{b}={v}" for x in path for b, v in x.conditions}), sum(x.law.mean for x in path), found.truncated
            if not found:
                yield m, t, f"{a}={k}", -1, None, [], [], None, found.truncated

    return ask(models, goals, "model_id string, goal string, objective string, solution int, source int, moves array<string>, requires array<string>, delay double, truncated boolean", answer, start)


def validation_report(models: Models, goals: list[str], start: str | None = None, k: int = 64, hitting: DataFrame | None = None) -> DataFrame:
    """Lower bound, exact value, and how they compare, with the critical path and the time of the likeliest run.

    hitting: (model_id, goal, q25, active), what a simulator says: the time by which a quarter of its runs are there,
    and the automata that got active; as hitting_times() gives it. delay_gap: q25 less the critical path;
    scenario_overlap: the likeness of active and the automata of the witness run; oracle: 'maboss' or 'none'.
    """

    def answer(net, ctx, g, m, t):
        wide = net.expanded()
        low, solved = kernels.anytime_bound(net, ctx, g, k), kernels.exact_probability(wide, ctx, g)
        best, run = kernels.top_scenarios(net, ctx, g, 1), kernels.witness(net, ctx, g)
        return [(m, t, low, solved and solved[0], kernels.earliest_delay(wide, ctx, g), best[0][1] if best else None, sorted({x.automaton for x in run[1]}) if run else [])]

    found = ask(models, goals, "model_id string, goal string, binf double, exact double, t_delay double, best_delay double, moved array<string>", answer, start)
    found = bound_metrics(found, "binf", "exact")
    if hitting is None:
        return found.drop("moved").select("*", F.lit(None).cast("double").alias("delay_gap"), F.lit(None).cast("double").alias("scenario_overlap"), F.lit("none").alias("oracle"))
    known = found.join(hitting.select("model_id", "goal", "q25", "active"), ["model_id", "goal"], "left")
    overlap = F.when(F.col("active").isNotNull(), jaccard("moved", "active"))
    return known.withColumns({"delay_gap": F.col("q25") - F.col("t_delay"), "scenario_overlap": overlap, "oracle": F.when(F.col("active").isNull(), "none").otherwise("maboss")}).drop("moved", "q25", "active")


#: Levels of hitting times that are reported.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def hitting_times(texts: DataFrame, goals: list[str], samples: int | None = None, max_time: float | None = None, program: str = "MaBoSS") -> DataFrame:
    """(model_id, goal, prob, quantiles, q25, active): what the simulator, where it is installed on the executors,
    says of MaBoSS models (model_id, text, extra) with extra the parameters. One task a model and goal.

    prob: the chance that the goal's node is active at the end; quantiles: by level the first time at which it is
    active with that chance; active: nodes that are so with a chance of a half at some time. No rows without it.
    """
    spark = texts.sparkSession
    asked = texts.select("model_id", "text", "extra").join(F.broadcast(spark.createDataFrame([(g, parse_goal(g)[0]) for g in goals], "goal string, node string")))
    schema = "model_id string, goal string, prob double, quantiles map<double,double>, q25 double, active array<string>"

    def run(batches):
        for batch in batches:
            for q in batch.itertuples():
                series = tools.maboss_series(q.text, q.extra or "", samples, max_time, program) if tools.detect(program) else None
                if series:
                    first = {x: next((t for t, p in series if p.get(q.node, 0.0) >= x), None) for x in QUANTILES}
                    active = sorted({n for _, p in series for n, v in p.items() if v >= 0.5})
                    yield pd.DataFrame([(q.model_id, q.goal, series[-1][1].get(q.node, 0.0), first, first[0.25], active)], columns=["model_id", "goal", "prob", "quantiles", "q25", "active"])

    return asked.repartition(max(1, len(goals)), "model_id", "goal").mapInPandas(run, schema)


def causality_texts(models: Models, goals: list[str], kind: str = "text", start: str | None = None) -> DataFrame:
    """(model_id, goal, text): the causality graph as lines, as DOT or as JSON; solutions with their own delay."""
    if kind not in ("text", "dot", "json"):
        raise ValueError(f"no kind {kind}")

    def answer(net, ctx, g, m, t):
        graph = sorted((f"{a}={k}", [([x.text() for x in p], sorted({f"{b}={v}" for x in p for b, v in x.conditions}), sum(x.law.mean for x in p)) for _, p in found]) for (a, k), found in kernels.causality(net, ctx, g).items())
        if kind == "json":
            text = json.dumps({"root": t, "objectives": [{"objective": o, "solutions": [{"path": p, "requires": r, "delay": d} for p, r, d in found]} for o, found in graph]})
        elif kind == "dot":
            lines = [f'  "{o}" [shape=box];' for o, _ in graph]
            for o, found in graph:
                for i, (_, requires, d) in enumerate(found):
                    lines += [f'  "{o}/{i}" [label="{d:g}", shape=circle];', f'  "{o}" -> "{o}/{i}";', *(f'  "{o}/{i}" -> "{r}";' for r in requires)]
            text = "\n".join(["digraph causality {", *lines, "}", ""])
        else:
            text = "\n".join(x for o, found in graph for x in (o, *(f"  {'; '.join(p) or 'there already'} [{d:g}]" + (f" needs {', '.join(r)}" if r else "") for p, r, d in found)))
        return [(m, t, text)]

    return ask(models, goals, "model_id string, goal string, text string", answer, start)


def attractors(models: Models, cap: int = 200_000, most: int = states.LISTED) -> DataFrame:
    """(model_id, attractor, size, states, truncated): terminal components of the whole state graph.

    Up to `cap` states by enumeration, beyond by decision diagrams, of which `most` states are listed each (truncated:
    there are more). A model whose diagrams grow too large has one row with truncated and nothing else.
    """

    def answer(net, q):
        space, found = kernels.Space(net), kernels.attractors(net, cap)
        if found is not None:
            each = [(len(own), own, False) for own in found]
        else:
            try:
                dd = diagrams.Diagrams(net, states.NODES)
                each = sorted((dd.count(x), *diagrams.listed(dd, x, most)) for x in dd.terminal_components())
            except (MemoryError, RecursionError):
                yield q["model_id"], None, None, None, True
                return
        for i, (n, own, more) in enumerate(each):
            yield q["model_id"], i, None if n >= 10**38 else Decimal(n), [", ".join(f"{a}={k}" for a, k in zip(space.names, s)) for s in own], more

    return kernel(models.models.select("model_id", "text"), "model_id string, attractor int, size decimal(38,0), states array<string>, truncated boolean", answer)


def cached(spark: SparkSession, folder: str, question: str, models: Models, answer) -> DataFrame:
    """answer(models), kept as Parquet under a hash of the question and the models' texts, and read back when asked again."""
    # sums of four 64-bit hashes, in any order; no row holds all models
    sums = models.models.select(*(F.xxhash64("text", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in range(4))).agg(F.count(F.lit(1)), *(F.sum(f"h{k}") for k in range(4))).first()
    path = f"{folder}/{hashlib.sha256(f'{question}|{tuple(map(str, sums))}'.encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        answer(models).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


SWEEP = "model string, automata int, local_states int, transitions int, states decimal(38,0), value decimal(38,0), time_ms double, note string"


def _swept(net: Network, metric: str, reps: int) -> tuple:
    n = math.prod(net.levels.values())
    value, best, note = None, None, None
    try:
        for _ in range(max(1, reps)):
            began = time.perf_counter()
            value = kernels.exact_reach(net, net.initial, ("", 0))[1] if metric == "reachability" else diagrams.fixpoint_count(net) if metric == "fixpoints" else None
            took = (time.perf_counter() - began) * 1e3
            best = took if best is None else min(best, took)
    except (MemoryError, RecursionError, ArithmeticError) as e:
        note = f"{type(e).__name__}: {e}"
    return len(net.levels), sum(net.levels.values()), len(net.transitions), *(None if x is None or x >= 10**38 else Decimal(x) for x in (n, value)), best, note


def _metric(metric: str) -> str:
    if metric not in ("reachability", "fixpoints", "load"):
        raise ValueError(f"no metric {metric}")
    return metric


def sweep(models: Models, metric: str = "reachability", reps: int = 1) -> DataFrame:
    """(model, automata, local_states, transitions, states, value, time_ms, note) of all models, in no order: models are
    dealt out one by one. time_ms: the least of reps; note: why there is no value."""
    kind = _metric(metric)
    return kernel(models.models.select("model_id", "text"), SWEEP, lambda net, q: [(q["model_id"], *_swept(net, kind, reps))])


def sweep_texts(texts: DataFrame, metric: str = "reachability", reps: int = 1) -> DataFrame:
    """sweep() of (model_id, format, text): a text that can't be read has a row with a note alone."""
    kind = _metric(metric)
    names = [x.split()[0] for x in SWEEP.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for q in batch.itertuples():
                try:
                    rows.append((q.model_id, *_swept(READERS[q.format](q.text, name=q.model_id), kind, reps)))
                except (ValueError, KeyError) as e:
                    rows.append((q.model_id, *[None] * (len(names) - 2), str(e)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return dealt(texts).mapInPandas(run, SWEEP)


def ablation(models: Models, goals: list[str], start: str | None = None, budget: int = 256, reps: int = 1) -> DataFrame:
    """(model_id, goal, strategy, value, lower, upper, exact, nodes, time_ms, agrees): the chain of states, decision
    diagrams, and the bracket, each with its least time of reps, and whether it agrees with the exact value.

    The exact value is the chain's, else the diagrams'; agrees is null where there is none. Chain and diagrams agree
    to 1e-6, a bracket holds it to 1e-9. A strategy that the model is too large for has no value.
    """

    def timed(run):
        best, found = math.inf, None
        for _ in range(max(1, reps)):
            began = time.perf_counter()
            found = run()
            best = min(best, (time.perf_counter() - began) * 1e3)
        return found, best

    def answer(net, ctx, g, m, t):
        wide = net.expanded()
        chain, t1 = timed(lambda: kernels.ctmc(wide, ctx, g))
        symbolic, t2 = timed(lambda: diagrams.reach_probability(wide.keep(wide.cone(g[0])), ctx, g, max_nodes=100_000))
        (low, high), t3 = timed(lambda: kernels.bracket(net, ctx, g, budget))
        ref = chain[0] if chain else symbolic[0] if symbolic else None
        near = lambda x: None if ref is None or x is None else abs(x - ref) <= 1e-6
        for name, own, nodes, took in (("chain", chain, None, t1), ("diagrams", symbolic, symbolic and symbolic[2], t2)):
            value = own[0] if own else None
            yield m, t, name, value, value, value, own is not None, nodes, took, near(value)
        yield m, t, "bracket", None, low, high, high - low <= 1e-9, None, t3, None if ref is None else low - 1e-9 <= ref <= high + 1e-9

    return ask(models, goals, "model_id string, goal string, strategy string, value double, lower double, upper double, exact boolean, nodes int, time_ms double, agrees boolean", answer, start)


# Trajectories: (time, active, p).


def marginals(trajectory: DataFrame, node: str) -> DataFrame:
    inside = F.when(F.array_contains("active", F.lit(node)), F.col("p")).otherwise(0.0)
    return trajectory.groupBy("time").agg(F.sum(inside).alias("marginal"))


def first_passages(marginal: DataFrame, levels: list[float] = QUANTILES) -> DataFrame:
    """(level, time): the first time at which the marginal is at least the level; null if never. Of a node that stays
    active once it is, these are the quantiles of its hitting time."""
    each = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("level")) for x in levels))).alias("x")
    return marginal.select("time", "marginal", each).groupBy(F.col("x.level").alias("level")).agg(F.min(F.when(F.col("marginal") >= F.col("x.level"), F.col("time"))).alias("time"))


def activation_times(trajectory: DataFrame, level: float) -> DataFrame:
    """(node, time): for each node the first time at which its marginal is at least the level."""
    each = trajectory.select("time", "p", F.explode("active").alias("node")).groupBy("node", "time").agg(F.round(F.sum("p"), 9).alias("marginal"))
    return each.groupBy("node").agg(F.min(F.when(F.col("marginal") >= level, F.col("time"))).alias("time"))


def final_marginals(trajectory: DataFrame) -> DataFrame:
    """(node, p) at the last time."""
    last = trajectory.agg(F.max("time").alias("time"))
    return trajectory.join(F.broadcast(last), "time").select("p", F.explode("active").alias("node")).groupBy("node").agg(F.sum("p").alias("p"))


def bound_metrics(df: DataFrame, low: str, exact: str, tolerance: float = 1e-9) -> DataFrame:
    """df with sound, tightness and rel_gap of a lower bound."""
    b, e = F.col(low), F.col(exact)
    tight = F.when(e <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), b / e)))
    gap = F.when(e <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (e - b) / e))
    return df.withColumn("sound", b <= e + tolerance).withColumn("tightness", tight).withColumn("rel_gap", gap)


def jaccard(a: str, b: str) -> Column:
    """Share of common members of two arrays; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# A catalogue of models.


class Repository:
    """Models by id with tags, as one Parquet table (id, tags, text) under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self.schema = spark, f"{folder}/models", "id string, tags array<string>, text string"

    def init(self) -> Repository:
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)
        return self

    def list(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _replace(self, rows: DataFrame) -> None:
        held = rows.collect()  # a catalogue's index is small, and its own folder is overwritten
        self.spark.createDataFrame(held, self.schema).coalesce(1).write.mode("overwrite").parquet(self.path)

    def add(self, model_id: str, text: str, tags: list[str] = ()) -> None:
        new = self.spark.createDataFrame([(model_id, list(tags), text)], self.schema)
        old = self.list().where(F.col("id") == model_id).select(F.col("id").alias("_id"), F.col("tags").alias("_tags"))
        merged = new.join(old, F.col("id") == F.col("_id"), "left").select("id", F.array_sort(F.array_union("tags", F.coalesce("_tags", F.array().cast("array<string>")))).alias("tags"), "text")
        self._replace(self.list().where(F.col("id") != model_id).union(merged))

    def remove(self, model_id: str) -> None:
        self._replace(self.list().where(F.col("id") != model_id))

    def tag(self, model_id: str, tags: list[str]) -> None:
        more = F.array_sort(F.array_union("tags", F.array(*map(F.lit, tags))))
        self._replace(self.list().select("id", F.when(F.col("id") == model_id, more).otherwise(F.col("tags")).alias("tags"), "text"))

    def search(self, text: str | None = None, tag: str | None = None) -> DataFrame:
        out = self.list()
        if text:
            out = out.where(F.lower("id").contains(text.lower()) | F.exists("tags", lambda t: F.lower(t).contains(text.lower())))
        return out.where(F.array_contains("tags", tag)) if tag else out

    def models(self) -> Models:
        return Models.from_texts(self.list().select(F.col("id").alias("model_id"), F.lit("anx").alias("format"), "text"))

    def bundle(self, model_id: str) -> str:
        row = self.list().where(F.col("id") == model_id).first()
        if row is None:
            raise KeyError(model_id)
        return f"# run-bundle\n# id: {row.id}\n# tags: {','.join(row.tags)}\n\n{row.text}"
