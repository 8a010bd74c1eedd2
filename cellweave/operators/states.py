"""State spaces as rows: a state is one mixed-radix number, a transition a broadcast row with a guard."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import Models, dealt, encode, fires, kernel, state_text
from ..plans.staging import cut
from . import chains, diagrams, graphs, kernels, local
from .containment import extremal_sets

#: Spaces of up to so many states are rows; larger ones are decision diagrams, one task a model.
FIXPOINT_CAP, TRAP_CAP = 1_000_000, 1_000_000
#: Traps of up to so many partial assignments are compared as rows.
MINIMAL_CAP = 20_000
#: Of a larger space so many answers are listed, from diagrams of so many nodes; `truncated` says where that cut any.
LISTED, NODES = 100_000, 2_000_000


def all_states(spaces: DataFrame, cap: int = FIXPOINT_CAP) -> DataFrame:
    """(model_id, sid) of every state of the spaces within the cap, made in pieces so that no row is large."""
    step = 4096
    heads = spaces.where(F.col("n_states") <= cap).select("model_id", "n_states", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_states") - 1, F.lit(step).cast("long"))).alias("head"))
    return heads.select("model_id", F.explode(F.sequence(F.col("head"), F.least(F.col("head") + step, F.col("n_states")) - 1)).alias("sid"))


def successors(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(states' columns, tid, rate, dst): every state with every transition that fires in it.

    Meets by model and filters by guard. transitions: as encode() gives them; a model's are few, so AQE broadcasts
    them or splits a hot model's states.
    """
    t = transitions.select("model_id", "tid", "rate", "guard", "delta")
    return states.join(t, "model_id").where(fires("sid")).withColumn("dst", F.col("sid") + F.col("delta")).drop("guard", "delta")


def start_states(models: Models, spaces: DataFrame) -> DataFrame:
    """(model_id, sid): the product of the levels that each automaton may start at.

    Starts are numbers in mixed radix over those levels, dealt out in ranges of 4096 and read off digit by digit, so
    that no row holds more than a range, however many starts a model has.
    """
    given = models.initial.groupBy("model_id", "automaton").agg(F.array_sort(F.collect_set("level")).alias("given"))
    each = spaces.select("model_id", F.explode("digits").alias("d")).select("model_id", "d.aidx", "d.automaton", "d.stride", "d.levels")
    each = each.join(given, ["model_id", "automaton"], "left").withColumn("given", F.coalesce("given", F.sequence(F.lit(0), F.col("levels") - 1)))
    lists = each.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("aidx", "stride", "given"))).alias("parts"))
    lists = lists.withColumn("n", F.aggregate("parts", F.lit(1).cast("long"), lambda n, p: n * F.size(p["given"]))).where("n > 0")
    step = 4096
    upto = lambda first, size, by: F.explode(F.sequence(first, F.least(first + size, F.col("n")) - 1, F.lit(by).cast("long")))
    far = lists.select("model_id", "parts", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step * step).cast("long"))).alias("far"))
    heads = dealt(far.select("model_id", "parts", "n", upto(F.col("far"), step * step, step).alias("head")))
    ranks = heads.select("model_id", "parts", upto(F.col("head"), step, 1).alias("rank"))
    zero = F.struct(F.lit(0).cast("long").alias("sid"), F.col("rank").alias("rest"))
    digit = lambda x, p: F.get(p["given"], F.pmod(x["rest"], F.size(p["given"])).cast("int")).cast("long") * p["stride"]
    read = F.aggregate("parts", zero, lambda x, p: F.struct((x["sid"] + digit(x, p)).alias("sid"), F.call_function("div", x["rest"], F.size(p["given"])).alias("rest")))
    return ranks.select("model_id", read["sid"].alias("sid"))


def reachable(models: Models, absorb: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(model_id, sid): states reachable from the starts, breadth first; states in absorb (model_id, sid) stop there."""
    spaces, transitions = encode(models)
    return _reached(cut(start_states(models, spaces).distinct()), cut(transitions), absorb, max_rounds)


def _reached(starts: DataFrame, transitions: DataFrame, absorb: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """reachable() from written starts and transitions."""
    known = front = starts
    for _ in range(max_rounds):
        go = front if absorb is None else front.join(absorb, ["model_id", "sid"], "left_anti")
        step = successors(go, transitions).select("model_id", F.col("dst").alias("sid")).distinct()
        front = cut(step.join(known, ["model_id", "sid"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.union(front)
    raise RuntimeError("exploration did not end")


def _listed(models: Models, spaces: DataFrame, cap: int, column: str, most: int, answer) -> DataFrame:
    """(model_id, column, truncated) for the models whose spaces (model_id, n_states) exceed the cap, or 2^62.

    answer(net) gives a store of diagrams, a set in it, and the text of a member. A model whose diagrams outgrow NODES
    has one row without a member, and so has one with none to list that is not sure to have none.
    """
    small = spaces.where(F.col("n_states") <= cap).select("model_id")
    large = models.models.select("model_id", "text").join(small, "model_id", "left_anti")

    def run(net, q):
        try:
            dd, found, text = answer(net)
            own, more = diagrams.listed(dd, found, most)
        except (MemoryError, RecursionError):
            return [(q["model_id"], None, True)]
        return [(q["model_id"], text(x), more) for x in own]

    return kernel(large, f"model_id string, {column} string, truncated boolean", run)


def fixpoints(models: Models, most: int = LISTED, cap: int = FIXPOINT_CAP) -> DataFrame:
    """(model_id, state, truncated): states of the whole space in which nothing fires.

    Up to `cap` states a model by an anti-join, beyond by decision diagrams, of which `most` are listed; truncated:
    there are more. A null state with truncated: the model is beyond the diagrams too.
    """
    spaces, transitions = encode(models)
    states = all_states(spaces, cap)
    t = transitions.select(F.col("model_id").alias("_m"), "guard")
    still = states.join(t, (F.col("model_id") == F.col("_m")) & fires("sid"), "left_anti")
    rows = still.join(spaces, "model_id").select("model_id", state_text().alias("state"), F.lit(False).alias("truncated"))

    def answer(net):
        dd = diagrams.Diagrams(net, NODES)
        return dd, dd.fixpoints(), lambda x: ", ".join(f"{a}={k}" for a, k in zip(dd.names, x))

    return rows.union(_listed(models, spaces, cap, "state", most, answer))


def fixpoint_counts(models: Models) -> DataFrame:
    """(model_id, fixpoints): counted on states where those can be listed, by decision diagrams else."""
    spaces, _ = encode(models)
    small = spaces.where(F.col("n_states") <= FIXPOINT_CAP).select("model_id")
    n = fixpoints(Models(models.automata, models.transitions, models.initial, models.models.join(small, "model_id", "left_semi"))).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    every = models.models.select("model_id", "text").join(spaces.select("model_id", "n_states"), "model_id", "left").join(n, "model_id", "left")
    listed = F.coalesce(F.col("n_states") <= FIXPOINT_CAP, F.lit(False))
    large = kernel(every.where(~listed).select("model_id", "text"), "model_id string, fixpoints decimal(38,0)", lambda net, q: [(q["model_id"], _decimal(diagrams.fixpoint_count(net)))])
    return every.where(listed).select("model_id", F.coalesce("n", F.lit(0)).cast("decimal(38,0)").alias("fixpoints")).union(large)


def trap_spaces(models: Models, minimal: bool = False, most: int = LISTED, cap: int = TRAP_CAP) -> DataFrame:
    """(model_id, space, truncated): partial assignments that no move can leave; minimal: none inside another's.

    A partial assignment is a number over levels + 1 digits, 0 for free. It is no trap where some transition leaves a
    fixed level and no fixed level contradicts its conditions. Up to `cap` partial assignments a model are rows,
    beyond they are decision diagrams, of which `most` members are listed; see fixpoints(). Minimal ones are those whose
    fixed levels lie in no other's, found by a containment join up to MINIMAL_CAP partial assignments, by diagrams beyond.
    """
    cap = min(cap, MINIMAL_CAP) if minimal else cap
    spaces, transitions = encode(models, extra=1)
    states = all_states(spaces, cap)
    t = transitions.select(F.col("model_id").alias("_m"), "guard")
    digit = lambda g: F.pmod(F.call_function("div", F.col("sid"), g["stride"]), g["levels"] + 1)
    leaves = (digit(F.col("guard")[0]) == F.col("guard")[0]["lvl"] + 1) & F.forall(F.slice("guard", 2, F.greatest(F.size("guard") - 1, F.lit(1))), lambda g: (g["lvl"] >= 0) & ((digit(g) == 0) | (digit(g) == g["lvl"] + 1)))
    traps = states.join(t, (F.col("model_id") == F.col("_m")) & leaves, "left_anti").join(spaces, "model_id")
    fixed = F.filter(F.transform("digits", lambda d: F.struct(d["automaton"].alias("a"), (F.pmod(F.call_function("div", F.col("sid"), d["stride"]), d["levels"] + 1) - 1).alias("k"))), lambda x: x["k"] >= 0)
    text = F.array_join(F.transform(fixed, lambda x: F.concat_ws("=", x["a"], x["k"].cast("string"))), ", ")
    rows = traps.select("model_id", text.alias("space"), F.lit(False).alias("truncated"))
    if minimal:
        most_fixed = extremal_sets(traps.select(F.col("model_id").alias("group_id"), fixed.alias("members")), "maximal")
        text = F.array_join(F.transform("members", lambda x: F.concat_ws("=", x["a"], x["k"].cast("string"))), ", ")
        rows = most_fixed.select(F.col("group_id").alias("model_id"), text.alias("space"), F.lit(False).alias("truncated"))

    def answer(net):
        dd = diagrams.Spaces(net, NODES)
        found = dd.traps()
        return dd, dd.minimal(found) if minimal else found, lambda x: ", ".join(f"{a}={k - 1}" for a, k in zip(dd.names, x) if k)

    return rows.union(_listed(models, spaces, cap, "space", most, answer))


def reachable_counts(models: Models, rounds: bool = False) -> DataFrame:
    """(model_id, reachable_states) from the models' starts: one task a model, by enumeration or, for large spaces, by
    decision diagrams. With rounds, by joins over the cluster instead, for spaces that fit its disks and no task; null
    for models of more than 2^62 states, which have no numbers."""
    if rounds:
        n = reachable(models).groupBy("model_id").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
        numbered = encode(models)[0].select("model_id", F.lit(True).alias("numbered"))
        known = models.automata.select("model_id").distinct().join(numbered, "model_id", "left").join(n, "model_id", "left")
        return known.select("model_id", F.when(F.col("numbered"), F.coalesce("n", F.lit(0).cast("decimal(38,0)"))).alias("reachable_states"))
    return kernel(models.models.select("model_id", "text"), "model_id string, reachable_states decimal(38,0)", lambda net, q: [(q["model_id"], _decimal(kernels.exact_reach(net, net.initial, ("", 0))[1]))])


def _decimal(n: int) -> Decimal | None:
    """Null where a count has more than 38 digits."""
    return Decimal(n) if n < 10**38 else None


def symbolic_reachability(models: Models, goals: DataFrame, rounds: bool = False) -> DataFrame:
    """(query_id, reachable, reachable_states) over whole networks. goals: (query_id, model_id, automaton, level).

    As reachable_counts().
    """
    if rounds:
        return _explored(models, goals).withColumn("reachable_states", F.col("reachable_states").cast("decimal(38,0)"))

    def answer(net, q):
        hit, n = kernels.exact_reach(net, net.initial, (q["automaton"], int(q["level"])))
        return [(q["query_id"], hit, _decimal(n))]

    asked = goals.join(models.models.select("model_id", "text"), "model_id").select("query_id", "automaton", "level", "text")
    return kernel(asked, "query_id string, reachable boolean, reachable_states decimal(38,0)", answer)


def at_goals(spaces: DataFrame, goals: DataFrame, states: DataFrame) -> DataFrame:
    """(query_id, model_id, sid) of the states in which a goal (query_id, model_id, automaton, level) holds."""
    digits = spaces.select("model_id", F.explode("digits").alias("d")).select("model_id", "d.automaton", "d.stride", "d.levels")
    hit = F.pmod(F.call_function("div", F.col("sid"), F.col("stride")), F.col("levels")) == F.col("level")
    return goals.join(digits, ["model_id", "automaton"]).join(states, "model_id").where(hit).select("query_id", "model_id", "sid")


def bracket(models: Models, goals: DataFrame, rounds: tuple[int, ...] = (16,), least: float = 1e-4) -> DataFrame:
    """(query_id, budget, lower, upper): bounds on the probability to reach each goal (query_id, model_id, automaton,
    level) after so many rounds in which every state of at least `least` probability jumps.

    All starts count, with equal shares. What is left in other states keeps its probability: lower is what has hit the
    goal, upper all but what is where local states exclude it, deadlocks among those. States are those that are reached.
    """
    spaces, transitions = map(cut, encode(models))
    starts = cut(start_states(models, spaces).distinct())
    found = cut(_reached(starts, transitions))
    edges = successors(found, transitions).select("model_id", F.col("sid").alias("src"), "dst", "rate")
    jumps = cut(chains.jump_chain(edges).select("model_id", "src", "dst", "p"))
    hits = at_goals(spaces, goals, found).withColumn("hit", F.lit(True))
    stop = cut(hits.union(local.excluded(models, spaces, goals, found).select("query_id", "model_id", "sid", F.lit(False))))
    go = goals.select("query_id", "model_id").join(jumps, "model_id").join(stop.withColumnRenamed("sid", "src"), ["query_id", "model_id", "src"], "left_anti")
    share = starts.groupBy("model_id").agg((1.0 / F.count(F.lit(1))).alias("mass"))
    begun = goals.select("query_id", "model_id").join(starts, "model_id").join(share, "model_id").select("query_id", "model_id", F.col("sid").alias("node"), "mass")
    held = chains.spread(go, begun, rounds, least).join(stop.withColumnRenamed("sid", "node"), ["query_id", "model_id", "node"], "left")
    sums = held.groupBy("query_id", F.col("mark").alias("budget")).agg(F.sum(F.when(F.col("hit"), F.col("mass"))).alias("yes"), F.sum(F.when(~F.col("hit"), F.col("mass"))).alias("no"))
    return sums.select("query_id", "budget", F.coalesce("yes", F.lit(0.0)).alias("lower"), (1 - F.coalesce("no", F.lit(0.0))).alias("upper"))


def attractors_by_rounds(models: Models, cap: int = FIXPOINT_CAP) -> DataFrame:
    """(model_id, attractor, state): the states of the terminal components of whole spaces of up to `cap` states, which the
    least state numbers, by rounds of joins over all models. A model beyond the cap has one row of nulls."""
    spaces, transitions = encode(models)
    large = models.automata.select("model_id").distinct().join(spaces.where(F.col("n_states") <= cap), "model_id", "left_anti")
    every = cut(all_states(spaces, cap))
    edges = cut(successors(every, cut(transitions)).select("model_id", F.col("sid").alias("src"), "dst"))
    moving = graphs.terminal(edges).select("model_id", F.col("node").alias("sid"), F.col("comp").alias("attractor"))
    still = every.join(edges.select("model_id", F.col("src").alias("sid")), ["model_id", "sid"], "left_anti").withColumn("attractor", F.col("sid"))
    found = moving.unionByName(still).distinct()
    rows = found.join(spaces, "model_id").select("model_id", "attractor", state_text().alias("state"))
    return rows.union(large.select("model_id", F.lit(None).cast("long"), F.lit(None).cast("string")))


def _explored(models: Models, goals: DataFrame) -> DataFrame:
    """As symbolic_reachability(), by rounds; a model of more than 2^62 states has nulls."""
    spaces, _ = encode(models)
    states = cut(reachable(models))
    n = states.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    hit = at_goals(spaces, goals, states).select("query_id").distinct().withColumn("hit", F.lit(True))
    known = goals.select("query_id", "model_id").join(spaces.select("model_id", F.lit(True).alias("numbered")), "model_id", "left").join(n, "model_id", "left").join(hit, "query_id", "left")
    return known.select("query_id", F.when(F.col("numbered"), F.coalesce("hit", F.lit(False))).alias("reachable"), F.when(F.col("numbered"), F.coalesce("n", F.lit(0))).alias("reachable_states"))
