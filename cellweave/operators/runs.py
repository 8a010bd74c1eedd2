"""Runs as rows: shortest ones to a goal, and the likeliest ones of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.frames import Models, encode
from ..plans.staging import cut
from . import states, structure


def shortest_runs(models: Models, goals: DataFrame) -> DataFrame:
    """(query_id, model_id, steps, start, run): for each goal (query_id, model_id, automaton, level) that is reached one
    shortest run, as the numbers of its transitions, and the state it starts from. Goals that are not reached have none.

    Breadth-first rounds keep of each new state the least (transition, state before) that leads to it, and of the
    nearest states of a goal the least is its end. Ways back are doubled, so that a run of n steps takes log n joins.
    """
    spaces, transitions = encode(models)
    transitions = cut(transitions)
    root = states.start_states(models, spaces).distinct()
    known = front = cut(root.select("model_id", "sid", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("tid"), F.lit(None).cast("long").alias("before")))
    depth = 0
    while True:
        depth += 1
        step = states.successors(front.select("model_id", "sid"), transitions).groupBy("model_id", F.col("dst").alias("sid")).agg(F.min(F.struct("tid", F.col("sid").alias("before"))).alias("way"))
        front = cut(step.join(known, ["model_id", "sid"], "left_anti").select("model_id", "sid", F.lit(depth).alias("depth"), "way.tid", "way.before"))
        if front.isEmpty():
            break
        known = known.union(front)
    known = cut(known)
    ends = states.at_goals(spaces, goals, known.select("model_id", "sid")).join(known.select("model_id", "sid", "depth"), ["model_id", "sid"])
    ends = cut(ends.groupBy("query_id", "model_id").agg(F.min(F.struct("depth", "sid")).alias("end")).select("query_id", "model_id", F.col("end.sid").alias("sid"), F.col("end.depth").alias("steps")))
    up = [known.where("before IS NOT NULL").select("model_id", "sid", F.col("before").alias("above"))]
    longest = ends.agg(F.max("steps")).first()[0] or 0
    while 2 << (len(up) - 1) <= longest:
        last = up[-1]
        up.append(cut(last.join(last.select("model_id", F.col("sid").alias("above"), F.col("above").alias("top")), ["model_id", "above"]).select("model_id", "sid", F.col("top").alias("above"))))
    on = ends.select("query_id", "model_id", "sid")
    for jump in reversed(up):
        on = cut(on.union(on.join(jump, ["model_id", "sid"]).select("query_id", "model_id", F.col("above").alias("sid"))).distinct())
    steps = on.join(known, ["model_id", "sid"]).groupBy("query_id", "model_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("tid").isNotNull(), F.struct("depth", "tid")))).alias("steps"), F.max(F.when(F.col("depth") == 0, F.col("sid"))).alias("start")
    )
    return steps.select("query_id", "model_id", F.size("steps").alias("steps"), "start", F.transform("steps", lambda s: s["tid"]).alias("run"))


#: Costs of jumps are whole billionths of the logarithm of their chance, so that ties are ties.
UNIT = 1_000_000_000


def likeliest_runs(jumps: DataFrame, start: DataFrame, goals: DataFrame, k: int = 5) -> DataFrame:
    """(model_id, rank, cost, prob, run): of every chain the k likeliest runs from its start until they first meet a goal.

    jumps: (model_id, src, dst, p); start and goals: (model_id, node). run lists the nodes. Of runs with one cost the one
    with the lesser nodes comes first. Each round lengthens runs by a jump and keeps the k best to every node; it drops
    those that cost more than the k-th that has arrived, and ends when none is left, so that no run is missed: costs
    never fall along a run, and what goes round for nothing has no way to a goal and is left out at first.
    """
    key = ["model_id"]
    jumps = cut(jumps.select("model_id", "src", "dst", "p"))
    ends = cut(goals.select("model_id", "node").distinct())
    own = jumps.join(ends.withColumnRenamed("node", "src"), ["model_id", "src"], "left_anti")
    hope = structure.closure(cut(own.select("model_id", F.col("dst").alias("src"), F.col("src").alias("dst"))), ends, key)
    steps = cut(own.join(hope.withColumnRenamed("node", "dst"), ["model_id", "dst"], "left_semi").select("model_id", "src", "dst", F.round(-F.log("p") * UNIT).cast("long").alias("c")))
    goal = ends.withColumn("arrived", F.lit(True))
    runs = start.join(hope, ["model_id", "node"], "left_semi").distinct().select("model_id", "node", F.lit(0).cast("long").alias("cost"), F.array("node").alias("run"))
    best = None

    def first(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy("cost", "run"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    while True:
        marked = cut(runs.join(goal, ["model_id", "node"], "left"))
        new = marked.where("arrived").select("model_id", "cost", "run")
        best = cut(first(new if best is None else best.drop("rank").union(new), "model_id"))
        limit = best.where(F.col("rank") == k).select("model_id", F.col("cost").alias("limit"))
        go = marked.where("arrived IS NULL").join(limit, "model_id", "left").where("limit IS NULL OR cost <= limit")
        longer = go.join(steps.withColumnRenamed("src", "node"), ["model_id", "node"]).select("model_id", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("run", F.array("dst")).alias("run"))
        runs = cut(first(longer, "model_id", "node").drop("rank"))
        if runs.isEmpty():
            return best.select("model_id", "rank", "cost", F.exp(-F.col("cost") / UNIT).alias("prob"), "run")
