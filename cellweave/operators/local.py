"""Arguments on local states: over-approximate reachability as a fixpoint inside one expression, for many variants at
once, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.frames import Models, kernel
from ..plans.staging import cut
from . import kernels, structure

#: A set of local states is one 63-bit number; models with more local states are answered by the kernel, one task each.
BITS = 62


def _large(models: Models) -> DataFrame:
    """(model_id, text) of the models with more local states than BITS; the text is made from the frames."""
    many = models.automata.groupBy("model_id").agg(F.sum("levels").alias("n")).where(F.col("n") > BITS).select("model_id")
    pick = lambda df: df.join(many, "model_id", "left_semi")
    return structure.with_texts(Models(pick(models.automata), pick(models.transitions), pick(models.initial), pick(models.models))).models.select("model_id", "text")


def _masks(models: Models) -> tuple[DataFrame, DataFrame]:
    """(bits, rules): bits (model_id, automaton, level, bit); rules: per model n_bits, initial set, and moves as
    (need, target) sets. Models with too many local states are left out, for _large() to have them."""
    levels = models.automata.select("model_id", "automaton", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    order = W.partitionBy("model_id").orderBy("automaton", "level")
    bits = levels.withColumn("place", F.row_number().over(order) - 1).withColumn("n_bits", F.count(F.lit(1)).over(W.partitionBy("model_id"))).where(F.col("n_bits") <= BITS)
    bits = bits.withColumn("bit", F.expr("shiftleft(1L, place)"))
    one = bits.select("model_id", "automaton", "level", "bit")
    given = models.initial.select("model_id", "automaton").distinct().withColumn("given", F.lit(True))
    start = bits.join(given, ["model_id", "automaton"], "left").join(models.initial.withColumn("listed", F.lit(True)).distinct(), ["model_id", "automaton", "level"], "left").where("given IS NULL OR listed")
    init = start.groupBy("model_id").agg(F.bit_or("bit").alias("init"))
    t = models.transitions
    need = t.select("model_id", "tid", F.explode(F.concat(F.array(F.struct("automaton", F.col("from_level").alias("level"))), "conditions")).alias("x")).select("model_id", "tid", "x.automaton", "x.level").join(one, ["model_id", "automaton", "level"], "left")
    # an atom that is no local state can't hold
    need = need.groupBy("model_id", "tid").agg(F.bit_or(F.coalesce("bit", F.lit(-(1 << 63)))).alias("need"))
    target = t.join(one.select("model_id", "automaton", F.col("level").alias("to_level"), F.col("bit").alias("target")), ["model_id", "automaton", "to_level"])
    moves = need.join(target.select("model_id", "tid", "automaton", "target"), ["model_id", "tid"]).groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("tid", "automaton", "need", "target"))).alias("moves"))
    rules = bits.select("model_id", "n_bits").distinct().join(init, "model_id", "left").join(moves, "model_id", "left")
    return one, rules.select("model_id", "n_bits", F.coalesce("init", F.lit(0).cast("long")).alias("init"), F.coalesce("moves", F.array().cast("array<struct<tid:int,automaton:string,need:bigint,target:bigint>>")).alias("moves"))


def closed_set(init: Column, blocked: Column, moves: str = "moves", n: str = "n_bits"):
    """The least set with init, without blocked, closed under the moves: sweeps until one adds nothing, as many as there are
    bits at most."""
    free = F.bitwise_not(blocked)
    sweep = lambda m: F.aggregate(moves, m, lambda acc, t: F.when(acc.bitwiseAND(t["need"]) == t["need"], acc.bitwiseOR(t["target"].bitwiseAND(free))).otherwise(acc))
    begun = F.struct(F.lit(None).cast("long").alias("before"), init.bitwiseAND(free).alias("now"))
    step = lambda x, _: F.when(x["before"] == x["now"], x).otherwise(F.struct(x["now"].alias("before"), sweep(x["now"]).alias("now")))
    return F.aggregate(F.sequence(F.lit(1), n), begun, step, lambda x: x["now"])


def may_reach(models: Models, blocked: DataFrame | None = None) -> DataFrame:
    """(model_id, variant, automaton, level): local states that are not excluded.

    blocked: (model_id, variant, automaton, level), sets that may neither be there at the start nor come up; without
    it one variant '' with nothing blocked.
    """
    one, rules = _masks(models)
    if blocked is None:
        variants = rules.select("model_id", F.lit("").alias("variant"), F.lit(0).cast("long").alias("blocked"))
    else:
        variants = blocked.join(one, ["model_id", "automaton", "level"], "left").groupBy("model_id", "variant").agg(F.bit_or(F.coalesce("bit", F.lit(0).cast("long"))).alias("blocked"))
    found = variants.join(rules, "model_id").select("model_id", "variant", closed_set(F.col("init"), F.col("blocked")).alias("found"))
    rows = found.join(one, "model_id").where("(found & bit) <> 0").select("model_id", "variant", "automaton", "level")
    each = F.collect_list(F.struct("automaton", "level")).alias("blocked")
    asked = _large(models).withColumn("variant", F.lit("")).withColumn("blocked", F.array().cast("array<struct<automaton:string,level:int>>")) if blocked is None else _large(models).join(blocked.groupBy("model_id", "variant").agg(each), "model_id")

    def answer(net, q):
        gone = frozenset((x["automaton"], int(x["level"])) for x in q["blocked"])
        return [(q["model_id"], q["variant"], a, k) for a, k in sorted(kernels.may_reach(net, net.initial, gone))]

    return rows.union(kernel(asked.select("variant", "model_id", "text", "blocked"), "model_id string, variant string, automaton string, level int", answer))


def excluded(models: Models, spaces: DataFrame, goals: DataFrame, states: DataFrame) -> DataFrame:
    """(query_id, model_id, sid): states from which a goal is excluded by an argument on local states alone. Of models
    with more local states than BITS none is: the argument is not made."""
    one, rules = _masks(models)
    own = spaces.select("model_id", F.explode("digits").alias("d")).select("model_id", "d.automaton", "d.stride", "d.levels").join(one, ["model_id", "automaton"])
    bits = own.groupBy("model_id").agg(F.collect_list(F.struct("stride", "levels", "level", "bit")).alias("bits"))
    here = F.aggregate("bits", F.lit(0).cast("long"), lambda m, b: F.when(F.pmod(F.call_function("div", F.col("sid"), b["stride"]), b["levels"]) == b["level"], m.bitwiseOR(b["bit"])).otherwise(m))
    # what a state can come to is worked out once, whatever the goals
    closed = states.join(bits, "model_id").join(rules, "model_id").select("model_id", "sid", closed_set(here, F.lit(0).cast("long")).alias("found"))
    goal = goals.join(one, ["model_id", "automaton", "level"]).select("query_id", "model_id", "bit")
    return closed.join(goal, "model_id").where("(found & bit) = 0").select("query_id", "model_id", "sid")


def _over_large(models: Models, goals: DataFrame, column: str, answer) -> DataFrame:
    """(query_id, column) of the goals in large models: the texts that answer(net, goal) gives."""
    asked = goals.select("query_id", "model_id", "automaton", "level").join(_large(models), "model_id").select("query_id", "automaton", "level", "text")
    return kernel(asked, f"query_id string, {column} string", lambda net, q: [(q["query_id"], x) for x in answer(net, (q["automaton"], int(q["level"])))])


def single_cutsets(models: Models, goals: DataFrame) -> DataFrame:
    """(query_id, member): single local states without which the goal is excluded, initial ones and the goal itself
    aside: one row a candidate, all in one job."""
    one, rules = _masks(models)
    g = goals.join(one.withColumnRenamed("bit", "goal"), ["model_id", "automaton", "level"]).select("query_id", "model_id", "goal")
    each = g.join(rules, "model_id").join(one, "model_id").where("(init & bit) = 0 AND bit <> goal")
    cuts = closed_set(F.col("init"), F.col("bit")).bitwiseAND(F.col("goal")) == 0
    reach = closed_set(F.col("init"), F.lit(0).cast("long")).bitwiseAND(F.col("goal")) != 0
    rows = each.where(cuts & reach).select("query_id", F.format_string("%s=%d", "automaton", "level").alias("member"))

    def answer(net, goal):
        if goal in kernels.may_reach(net, net.initial):
            first = {(a, k) for a in net.automata for k in net.admitted(net.initial, a)}
            for a in net.automata:
                for own in ((a, k) for k in range(net.levels[a])):
                    if own != goal and own not in first and goal not in kernels.may_reach(net, net.initial, frozenset((own,))):
                        yield f"{own[0]}={own[1]}"

    return rows.union(_over_large(models, goals, "member", answer))


def cutsets_by_levels(models: Models, goals: DataFrame, max_size: int = 3) -> DataFrame:
    """(query_id, members, size): the smallest sets of up to max_size local states without which a goal (query_id, model_id,
    automaton, level) that is possible is excluded; initial ones and the goal itself aside.

    Level by level: sets of one more state are joined from those that do not cut and differ in the last state, all of
    whose other parts must be among those too; each level is one frame of sets. members are in order of names. Models
    with more local states than BITS are left to single_cutsets() and the kernel.
    """
    one, rules = _masks(models)
    named = one.select("model_id", F.col("bit").alias("own"), F.format_string("%s=%d", "automaton", "level").alias("name"))
    g = goals.join(one.withColumnRenamed("bit", "goal"), ["model_id", "automaton", "level"]).select("query_id", "model_id", "goal")
    asked = g.join(rules, "model_id").where(closed_set(F.col("init"), F.lit(0).cast("long")).bitwiseAND(F.col("goal")) != 0)
    asked = cut(asked.select("query_id", "model_id", "goal", "init", "moves", "n_bits"))
    sets = asked.join(named, "model_id").where("(init & own) = 0 AND own <> goal").select("query_id", F.array("name").alias("members"), F.col("own").alias("mask"))
    found = None
    for size in range(1, max_size + 1):
        scored = sets.join(asked, "query_id").select("query_id", "members", "mask", (closed_set(F.col("init"), F.col("mask")).bitwiseAND(F.col("goal")) == 0).alias("cuts"))
        scored = cut(scored)
        hit = scored.where("cuts").select("query_id", F.array_join("members", ",").alias("members"), F.lit(size).alias("size"))
        found = hit if found is None else found.union(hit)
        if size == max_size:
            break
        rest = scored.where("NOT cuts").select("query_id", "members", "mask", F.slice("members", 1, size - 1).alias("head"), F.element_at("members", -1).alias("tail"))
        other = rest.select("query_id", "head", F.col("tail").alias("more"), F.col("mask").alias("mask2"))
        sets = rest.join(other, ["query_id", "head"]).where("more > tail").select("query_id", F.concat("members", F.array("more")).alias("members"), F.col("mask").bitwiseOR(F.col("mask2")).alias("mask"))
        # the parts without one of the first states; those without one of the last two are what was joined
        for k in range(size - 1):
            part = F.concat(F.slice("members", 1, k), F.slice("members", k + 2, size))
            sets = sets.withColumn("part", part).join(rest.select("query_id", F.col("members").alias("part")), ["query_id", "part"], "left_semi").drop("part")
    return found


def disabling_mutations(models: Models, goals: DataFrame) -> DataFrame:
    """(query_id, target): automata frozen at a level by which a goal that was possible is excluded."""
    one, rules = _masks(models)
    g = goals.join(one.withColumnRenamed("bit", "goal"), ["model_id", "automaton", "level"]).select("query_id", "model_id", "goal")
    own = one.groupBy("model_id", "automaton").agg(F.bit_or("bit").alias("all"))
    each = g.join(rules, "model_id").join(one, "model_id").join(own, ["model_id", "automaton"])
    base = closed_set(F.col("init"), F.lit(0).cast("long")).bitwiseAND(F.col("goal")) != 0
    start = F.col("init").bitwiseAND(F.bitwise_not(F.col("all"))).bitwiseOR(F.col("bit"))
    each = each.withColumn("frozen", F.filter("moves", lambda t: t["automaton"] != F.col("automaton")))
    gone = closed_set(start, F.lit(0).cast("long"), "frozen").bitwiseAND(F.col("goal")) == 0
    rows = each.where(base & gone).select("query_id", F.format_string("%s=%d", "automaton", "level").alias("target"))

    def answer(net, goal):
        if goal in kernels.may_reach(net, net.initial):
            for a in net.automata:
                for k in range(net.levels[a]):
                    if goal not in kernels.may_reach(net.frozen(a, k), {**(net.initial or {}), a: frozenset((k,))}):
                        yield f"{a}={k}"

    return rows.union(_over_large(models, goals, "target", answer))


def local_paths(models: Models, max_length: int | None = None) -> DataFrame:
    """(model_id, automaton, source, target, path): paths inside one automaton that visit no level twice; path lists
    the numbers of its transitions. All pairs at once, one join a length, as long as there are paths, or up to
    max_length transitions where that is asked for."""
    t = models.transitions.select("model_id", "automaton", F.col("from_level").alias("f"), F.col("to_level").alias("g"), F.col("tid").alias("n"))
    front = t.where("f <> g").select("model_id", "automaton", F.col("f").alias("source"), F.col("g").alias("target"), F.array("n").alias("path"), F.array("f", "g").alias("seen"))
    found = front
    top = models.automata.agg(F.max("levels")).first()[0] or 1
    for n in range(1, top - 1 if max_length is None else min(max_length, top - 1)):
        front = front if n % 8 else cut(front)
        if n % 8 == 0 and front.isEmpty():
            break
        front = front.join(t, ["model_id", "automaton"]).where((F.col("f") == F.col("target")) & ~F.array_contains("seen", F.col("g"))).select("model_id", "automaton", "source", F.col("g").alias("target"), F.concat("path", F.array("n")).alias("path"), F.concat("seen", F.array("g")).alias("seen"))
        found = found.union(front)
    return found.drop("seen")
