"""Local causality as tables: what a goal needs, in which ways, which of it can come about at all, and how soon.

An objective is a local state that is to be reached inside its automaton, a solution a path to it from a level where the
automaton may start. All models and goals share one memo: an objective is looked at once a model, whoever needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import law_mean
from ..plans.frames import Models
from ..plans.staging import cut
from . import local

OWN = ["model_id", "automaton", "level"]


def _starts(models: Models) -> DataFrame:
    """(model_id, automaton, level): levels that an automaton may start at, all where none is given."""
    given = models.initial.select("model_id", "automaton").distinct()
    free = models.automata.join(given, ["model_id", "automaton"], "left_anti")
    every = free.select("model_id", "automaton", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    return models.initial.join(models.automata.select("model_id", "automaton"), ["model_id", "automaton"], "left_semi").select(*OWN).distinct().union(every)


def _ways(models: Models) -> DataFrame:
    """(model_id, automaton, level, source, path): each solution of each local state; the empty path where it may start."""
    starts = _starts(models)
    stay = starts.select(*OWN, F.col("level").alias("source"), F.array().cast("array<int>").alias("path"))
    paths = local.local_paths(models).join(starts.withColumnRenamed("level", "source"), ["model_id", "automaton", "source"])
    return stay.union(paths.select("model_id", "automaton", F.col("target").alias("level"), "source", "path"))


def causality(models: Models, goals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What goals (query_id, model_id, automaton, level) need, as three tables.

    objectives (query_id, model_id, automaton, level): the goal, and every condition of a solution of an objective.
    solutions (model_id, automaton, level, sol, source, path): sol is a number without a meaning; path lists transitions.
    needs (model_id, automaton, level, sol, rest, need_automaton, need_level): a solution's conditions, each with the mean
    time that its path still takes from there on.

    A goal or condition that is no local state of its model is an objective without solutions. Rounds of joins follow
    conditions; solutions are kept of objectives that some goal has. Null goals need nothing but themselves.
    """
    steps = models.transitions.select("model_id", "tid", "conditions", law_mean("dist.rates").alias("mean"))
    ways = cut(_ways(models).withColumn("sol", F.monotonically_increasing_id()))
    at = ways.select(*OWN, "sol", F.posexplode("path").alias("pos", "tid")).join(steps, ["model_id", "tid"])
    # the times from each step on, a path at a time
    path = at.groupBy(*OWN, "sol").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "conditions"))).alias("steps"))
    rest = F.transform("steps", lambda s: F.struct(F.aggregate(F.filter("steps", lambda x: x["pos"] >= s["pos"]), F.lit(0.0), lambda t, x: t + x["mean"]).alias("rest"), s["conditions"].alias("conditions")))
    each = path.select(*OWN, "sol", F.explode(rest).alias("s")).select(*OWN, "sol", "s.rest", F.explode("s.conditions").alias("need"))
    needs = cut(each.groupBy(*OWN, "sol", F.col("need.automaton").alias("need_automaton"), F.col("need.level").alias("need_level")).agg(F.max("rest").alias("rest")))
    after = needs.select("model_id", "automaton", "level", "need_automaton", "need_level").distinct()
    known = front = cut(goals.select("query_id", *OWN).distinct())
    while True:
        step = front.join(after, OWN).select("query_id", "model_id", F.col("need_automaton").alias("automaton"), F.col("need_level").alias("level")).distinct()
        front = cut(step.join(known, ["query_id", *OWN], "left_anti"))
        if front.isEmpty():
            break
        known = known.union(front)
    asked = known.select(*OWN).distinct()
    keep = lambda df: df.join(asked, OWN, "left_semi")
    return known, keep(ways).select(*OWN, "sol", "source", "path"), keep(needs).select(*OWN, "sol", "rest", "need_automaton", "need_level")


def dead_objectives(objectives: DataFrame, solutions: DataFrame, needs: DataFrame) -> DataFrame:
    """(query_id, model_id, automaton, level): objectives that no derivation meets, from causality()'s tables.

    Conditions are struck off as what they ask for is found alive; an objective is alive once a solution of it has none
    left. Each round strikes off what the last one found.
    """
    left = needs.select("sol", "model_id", "need_automaton", "need_level").distinct()
    waiting = solutions.select(*OWN, "sol")
    alive = front = cut(waiting.join(left.select("sol"), "sol", "left_anti").select(*OWN).distinct())
    while not front.isEmpty():
        met = front.select("model_id", F.col("automaton").alias("need_automaton"), F.col("level").alias("need_level"))
        left = cut(left.join(met, ["model_id", "need_automaton", "need_level"], "left_anti"))
        waiting = cut(waiting.join(front, OWN, "left_anti"))
        front = cut(waiting.join(left.select("sol"), "sol", "left_anti").select(*OWN).distinct())
        alive = alive.union(front)
    return objectives.join(alive, OWN, "left_anti").select("query_id", *OWN)


def critical_delays(models: Models, goals: DataFrame) -> DataFrame:
    """(query_id, delay) for each goal: the least mean-delay critical path over its solutions, null where it has none.

    Steps of a path come one after another, a step waits for all its conditions, and of an objective's solutions the
    soonest counts: a path takes its whole length, or from a condition's own time on what is left of it. Values are the
    least ones that a derivation gives, so that cycles do no harm. In each round only solutions with an improved
    condition are looked at again, and those of objectives at or below a model's least improved value are settled.
    """
    objectives, solutions, needs = causality(models, goals)
    needs = cut(needs)
    steps = models.transitions.select("model_id", "tid", law_mean("dist.rates").alias("mean"))
    length = solutions.select(*OWN, "sol", F.explode_outer("path").alias("tid")).join(steps, ["model_id", "tid"], "left").groupBy(*OWN, "sol").agg(F.coalesce(F.sum("mean"), F.lit(0.0)).alias("length"))
    length = cut(length)
    free = length.join(needs.select("sol"), "sol", "left_anti").groupBy(*OWN).agg(F.min("length").alias("value"))
    known = front = cut(free)
    infinite = F.lit(float("inf"))
    while not front.isEmpty():
        least = front.groupBy("model_id").agg(F.min("value").alias("least"))
        value = known.select("model_id", F.col("automaton").alias("need_automaton"), F.col("level").alias("need_level"), F.col("value").alias("after"))
        new = front.select("model_id", F.col("automaton").alias("need_automaton"), F.col("level").alias("need_level"))
        open_ = needs.join(known.select(*OWN, F.col("value").alias("now")), OWN, "left").join(least, "model_id").where("now IS NULL OR now > least")
        touched = open_.join(new, ["model_id", "need_automaton", "need_level"], "left_semi").select("sol").distinct()
        waits = needs.join(touched, "sol", "left_semi").join(value, ["model_id", "need_automaton", "need_level"], "left")
        times = waits.groupBy("sol").agg(F.max(F.coalesce(F.col("after") + F.col("rest"), infinite)).alias("wait"))
        best = length.join(times, "sol").groupBy(*OWN).agg(F.min(F.greatest("length", "wait")).alias("better"))
        # what only rounding tells apart is no improvement
        front = cut(best.join(known, OWN, "left").where((F.col("better") < infinite) & (F.col("value").isNull() | (F.col("better") < F.col("value") * (1 - 1e-12)))).select(*OWN, F.col("better").alias("value")))
        known = cut(known.join(front.select(*OWN), OWN, "left_anti").union(front))
    finite = F.when(F.col("value") < infinite, F.col("value"))
    return goals.join(known, OWN, "left").select("query_id", finite.alias("delay"))
