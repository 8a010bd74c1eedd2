"""Markov chains as edge tables, many chains at once: jump probabilities, absorption, hitting times."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import cut
from . import solvers, structure


def merge_edges(edges: DataFrame) -> DataFrame:
    """(model_id, src, dst, rate): parallel edges add up."""
    return edges.groupBy("model_id", "src", "dst").agg(F.sum("rate").alias("rate"))


def exit_rates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("model_id", "src").agg(F.sum("rate").alias("exit_rate"))


def jump_chain(edges: DataFrame) -> DataFrame:
    """(model_id, src, dst, rate, p): p is the chance that src jumps to dst next. One pass after one shuffle."""
    total = F.sum("rate").over(W.partitionBy("model_id", "src"))
    return merge_edges(edges).withColumn("p", F.col("rate") / total)


def transient_mass(jumps: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(model_id, origin, node, mass) after so many jumps; what has no jump stays. start: (model_id, origin, node)."""
    mass = start.withColumn("mass", F.lit(1.0))
    leaving = jumps.select("model_id", F.col("src").alias("node"), "dst", "p")
    for _ in range(steps):
        moved = mass.join(leaving, ["model_id", "node"], "left").select("model_id", "origin", F.coalesce("dst", "node").alias("node"), (F.col("mass") * F.coalesce("p", F.lit(1.0))).alias("mass"))
        mass = moved.groupBy("model_id", "origin", "node").agg(F.sum("mass").alias("mass"))
    return mass


def absorption(edges: DataFrame, goals: DataFrame, absorbing: DataFrame | None = None, key: str = "string", largest: int = 1_000_000, tolerance: float = 1e-9) -> DataFrame:
    """(model_id, node, prob, mean_time) for every node: the chance to reach a goal, and the expected time where that
    is certain.

    edges: (model_id, src, dst, rate); goals and absorbing: (model_id, node), where chains end. A node without edges
    ends too. A chain of up to `largest` edges is in one task: solved exactly, together with others as one stack of
    matrices if it is small, and by sweeps over arrays beyond DENSE nodes. Larger chains go through rounds of joins,
    to the tolerance. What does not settle is null.
    """
    ends = goals.select("model_id", "node", F.lit(True).alias("goal"))
    if absorbing is not None:
        ends = ends.union(absorbing.select("model_id", "node", F.lit(False)))
    merged = cut(merge_edges(edges).select("model_id", "src", "dst", "rate"))
    large = cut(merged.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select("model_id"))
    some = not large.isEmpty()
    rows = merged.select("*", F.lit(None).cast("boolean").alias("goal"))
    rows = rows.union(ends.select("model_id", "node", F.lit(None).cast(dict(rows.dtypes)["dst"]), F.lit(None).cast("double"), "goal"))
    if some:
        rows = rows.join(large, "model_id", "left_anti")

    together = rows.repartition("model_id").sortWithinPartitions("model_id")
    out = together.mapInPandas(_whole("model_id", _solve), f"model_id {key}, node string, prob double, mean_time double")
    if some:
        mine = lambda df: df.join(large, "model_id", "left_semi")
        out = out.union(_absorbed(mine(merged), mine(ends), tolerance))
    return out


def _whole(key: str, solve: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What mapInPandas takes, over rows in order of the key: solve() gets whole groups, as many at once as a batch ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of a group of which more may come
        for part in batches:
            if not len(part):
                continue
            last = part[key].iloc[-1]
            full = (part[key] != last).to_numpy()
            if full.any():
                yield solve(pd.concat([*held, part[full]]))
                held = [part[~full]]
            elif held and held[-1][key].iloc[-1] != last:
                yield solve(pd.concat(held))
                held = [part]
            else:
                held.append(part)
        if held:
            yield solve(pd.concat(held))

    return run


def _absorbed(edges: DataFrame, ends: DataFrame, tolerance: float) -> DataFrame:
    """absorption() by joins: edges that leave an end count for nothing."""
    stop = cut(ends.groupBy("model_id", "node").agg(F.max("goal").alias("goal")))
    go = cut(edges.join(stop.select("model_id", F.col("node").alias("src")), ["model_id", "src"], "left_anti"))
    goals = stop.where("goal").select("model_id", "node")
    prob = cut(absorption_by_joins(go, goals, tolerance).withColumn("known", F.lit(True)))
    nodes = edges.select("model_id", F.col("src").alias("node")).union(edges.select("model_id", "dst")).union(stop.select("model_id", "node")).distinct()
    sure = cut(prob.where("sure").select("model_id", "node"))
    time = hitting_times_by_joins(go.join(sure.withColumnRenamed("node", "src"), ["model_id", "src"], "left_semi"), goals, tolerance)
    found = nodes.join(prob, ["model_id", "node"], "left").join(time, ["model_id", "node"], "left")
    # an end that is also no goal is none, however often it is listed
    return found.select("model_id", "node", F.when(F.col("known"), F.col("prob")).otherwise(0.0).alias("prob"), "mean_time")


#: Nodes up to which a chain is one matrix; larger ones go through sweeps.
DENSE = 3_000
#: Chains of at most so many nodes are solved together, as one stack of matrices.
SMALL = 48


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Absorption of all chains in rows at once."""
    chain, models = pd.factorize(rows["model_id"])
    both, names = pd.factorize(pd.concat([rows["src"], rows["dst"]]))
    k, n_rows = len(names) + 1, len(rows)
    mark = rows["goal"].notna().to_numpy()
    keys = np.concatenate([chain * k + both[:n_rows], np.where(mark, -1, chain * k + both[n_rows:])])
    nodes, at = np.unique(keys, return_inverse=True)
    if nodes[0] == -1:
        nodes, at = nodes[1:], at - 1
    src, dst, n = at[:n_rows], at[n_rows:], len(nodes)
    goal, over = np.zeros(n, bool), np.zeros(n, bool)
    goal[src[rows["goal"].eq(True).to_numpy(bool)]] = True
    over[src[mark]] = True
    go = ~mark & ~over[src]
    src, dst, rate = src[go], dst[go], rows["rate"].to_numpy(float)[go]
    prob, time = solvers.absorbed(src, dst, rate, goal, nodes // k, DENSE, SMALL)
    return pd.DataFrame({"model_id": models.take(nodes // k), "node": names.take(nodes % k), "prob": prob, "mean_time": time})


def absorption_by_joins(edges: DataFrame, goals: DataFrame, tolerance: float = 1e-9, max_rounds: int = 2_000, cut_every: int = 5) -> DataFrame:
    """(model_id, node, prob, sure) of all nodes by rounds of joins: for a chain too large for one task.

    goals end. What can't reach a goal has 0, what can't miss it 1 (sure), both by closures. All others are enclosed by a
    lower sequence from 0 and an upper one from 1, which meet since every such node leaves for one of those two; the
    middle is given where they are `tolerance` apart at most, null where they are not after max_rounds. Lineage is cut every few rounds.
    """
    ends = goals.select("model_id", "node").distinct()
    jumps = cut(jump_chain(edges.join(ends.withColumnRenamed("node", "src"), ["model_id", "src"], "left_anti")).select("model_id", "src", "dst", "p"))
    key = ["model_id", "node"]
    nodes = cut(jumps.select("model_id", F.col("src").alias("node")).union(jumps.select("model_id", "dst")).union(ends).distinct())
    back = cut(jumps.select("model_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    can = cut(structure.closure(back, ends, ["model_id"]))
    lost = cut(nodes.join(can, key, "left_anti"))
    risky = cut(structure.closure(back, lost, ["model_id"]))
    sure, doubt = can.join(risky, key, "left_anti"), cut(can.join(risky, key, "left_semi"))
    known = lost.select(*key, F.lit(0.0).alias("prob"), F.lit(False).alias("sure")).union(sure.select(*key, F.lit(1.0), F.lit(True)))
    if doubt.isEmpty():
        return known
    of = lambda name: doubt.select("model_id", F.col("node").alias(name))
    own = jumps.join(of("src"), ["model_id", "src"], "left_semi")
    inner = cut(own.join(of("dst"), ["model_id", "dst"], "left_semi"))
    into = own.join(sure.withColumnRenamed("node", "dst"), ["model_id", "dst"], "left_semi").groupBy("model_id", F.col("src").alias("node")).agg(F.sum("p").alias("into"))
    base = cut(doubt.join(into, key, "left").select(*key, F.coalesce("into", F.lit(0.0)).alias("into")))
    now = base.select(*key, F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    gap = None
    for i in range(1, max_rounds + 1):
        step = inner.join(now, (inner["model_id"] == now["model_id"]) & (inner["dst"] == now["node"])).groupBy(inner["model_id"], inner["src"].alias("node"))
        step = step.agg(F.sum(F.col("p") * F.col("low")).alias("a"), F.sum(F.col("p") * F.col("high")).alias("b"))
        now = base.join(step, key, "left").select(*key, (F.col("into") + F.coalesce("a", F.lit(0.0))).alias("low"), (F.col("into") + F.coalesce("b", F.lit(0.0))).alias("high"))
        if i % cut_every == 0 or i == max_rounds:
            now = cut(now)
            gap = now.agg(F.max(F.col("high") - F.col("low"))).first()[0]
            if gap <= tolerance:
                break
    middle = F.when(F.col("high") - F.col("low") <= tolerance, (F.col("low") + F.col("high")) / 2)
    return known.union(now.select(*key, middle, F.lit(False)))


def hitting_times_by_joins(edges: DataFrame, goals: DataFrame, tolerance: float = 1e-9, max_rounds: int = 2_000, cut_every: int = 5) -> DataFrame:
    """(model_id, node, mean_time) by rounds of one join and one aggregation, for nodes that are sure to reach a goal
    and whose successors all are; goals have 0.

    Sums from 0 stay below the times. Where a round adds less than e / (1 + e) of the time spent in a node itself to
    every node of a model, (1 + e) times the sums are not raised by a round, and so lie above: the relative error is at
    most e, the tolerance. Times of models that do not get there in max_rounds are null.
    """
    ends = goals.select("model_id", F.col("node").alias("src"))
    own = edges.join(ends, ["model_id", "src"], "left_anti")
    jumps = cut(jump_chain(own).select("model_id", "src", "dst", "p"))
    tau = cut(exit_rates(own).select("model_id", F.col("src").alias("node"), (1 / F.col("exit_rate")).alias("tau")))
    now = cut(tau.select("model_id", "node", F.lit(0.0).alias("mean_time")))
    settled = None
    for i in range(1, max_rounds + 1):
        after = jumps.join(now, (jumps["model_id"] == now["model_id"]) & (jumps["dst"] == now["node"])).groupBy(jumps["model_id"], jumps["src"].alias("node")).agg(F.sum(F.col("p") * F.col("mean_time")).alias("later"))
        new = tau.join(after, ["model_id", "node"], "left").select("model_id", "node", "tau", (F.col("tau") + F.coalesce("later", F.lit(0.0))).alias("mean_time"))
        if i % cut_every == 0 or i == max_rounds:
            before = cut(now)
            new = cut(new)
            gain = new.join(before.withColumnRenamed("mean_time", "_old"), ["model_id", "node"]).groupBy("model_id").agg(F.max((F.col("mean_time") - F.col("_old")) / F.col("tau")).alias("gain"))
            settled = cut(gain.select("model_id", (F.col("gain") <= tolerance / (1 + tolerance)).alias("settled")))
            if settled.where(~F.col("settled")).isEmpty():
                now = new.drop("tau")
                break
        now = new.drop("tau")
    time = now.join(settled, "model_id").select("model_id", "node", F.when(F.col("settled"), F.col("mean_time") * (1 + tolerance / 2)).alias("mean_time"))
    return time.union(goals.select("model_id", "node", F.lit(0.0)).distinct())


def spread(jumps: DataFrame, start: DataFrame, marks: tuple[int, ...], least: float = 0.0, keys: tuple[str, ...] = ("query_id", "model_id"), cut_every: int = 4, largest: int = 1_000_000) -> DataFrame:
    """(mark, keys, node, mass): where one is after so many rounds; a round lets every node of at least `least` mass jump.

    jumps: (some of keys, src, dst, p), none out of where a run ends; start: (keys, node, mass). What a node with less mass
    holds stays there and adds up, so no mass is lost: that at goals is a lower bound of reaching them, and all but that at
    places without hope an upper one, at any mark. Of the keys' groups those of up to `largest` jumps and starts go through
    all rounds in one task, many at once as arrays; larger ones go through joins, a round each.
    """
    shared = [k for k in keys if k in jumps.columns]
    if len(shared) < len(keys):
        jumps = jumps.join(start.select(*keys).distinct(), shared)
    rows = jumps.select(*keys, "src", "dst", "p", F.lit(True).alias("go"))
    rows = cut(rows.union(start.select(*keys, "node", "node", "mass", F.lit(False))))
    large = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select(*keys))
    some = not large.isEmpty()
    small = rows.join(large, [*keys], "left_anti") if some else rows
    kinds = dict(start.dtypes)
    together = small.repartition(keys[0]).sortWithinPartitions(*keys)
    schema = ", ".join(["mark int", *(f"`{k}` {kinds[k]}" for k in keys), f"node {kinds['node']}", "mass double"])
    out = together.mapInPandas(_whole(keys[0], lambda part: _spread(part, marks, least, keys)), schema)
    if some:
        own = rows.join(large, [*keys], "left_semi")
        begun = own.where("NOT go").select(*keys, F.col("src").alias("node"), F.col("p").alias("mass"))
        out = out.union(_spread_by_joins(own.where("go").drop("go"), begun, marks, least, keys, cut_every))
    return out


def _spread(rows: pd.DataFrame, marks: tuple[int, ...], least: float, keys: tuple[str, ...]) -> pd.DataFrame:
    """spread() of all groups in rows at once. rows: (keys, src, dst, p, go), without go a start of mass p in src; a group's
    are together."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        own = rows[k].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    both, names = pd.factorize(pd.concat([rows["src"], rows["dst"]]))
    nodes, at = np.unique(np.tile(group, 2) * len(names) + both, return_inverse=True)
    go, p, n = rows["go"].to_numpy(bool), rows["p"].to_numpy(float), len(nodes)
    src, dst = at[: len(rows)], at[len(rows) :][go]
    mass = np.bincount(src[~go], p[~go], n)
    src, p = src[go], p[go]
    leaves = np.bincount(src, minlength=n) > 0
    out = []
    for i in range(max(marks) + 1):
        if i in marks:
            held = np.flatnonzero(mass)
            own = {k: rows[k].to_numpy()[first[nodes[held] // len(names)]] for k in keys}
            out.append(pd.DataFrame({"mark": np.int32(i), **own, "node": names.take(nodes[held] % len(names)), "mass": mass[held]}))
        goes = np.where(leaves & (mass >= least), mass, 0.0)
        mass = mass - goes + np.bincount(dst, goes[src] * p, n)
    return pd.concat(out)


def _spread_by_joins(jumps: DataFrame, start: DataFrame, marks: tuple[int, ...], least: float, keys: tuple[str, ...], cut_every: int) -> DataFrame:
    """spread() by a join and an aggregation a round. jumps: (keys, src, dst, p)."""
    go = cut(jumps.select(*(F.col(k).alias(f"_{k}") for k in keys), "src", "dst", "p"))
    now, out = start.select(*keys, "node", "mass"), None
    for i in range(max(marks) + 1):
        if i in marks:
            now = cut(now)
            own = now.select(F.lit(i).alias("mark"), *keys, "node", "mass")
            out = own if out is None else out.union(own)
        elif i and i % cut_every == 0:
            now = cut(now)
        if i < max(marks):
            on = (F.col("node") == F.col("src")) & (F.col("mass") >= least)
            for k in keys:
                on &= F.col(k) == F.col(f"_{k}")
            now = now.join(go, on, "left").groupBy(*keys, F.coalesce("dst", "node").alias("node")).agg(F.sum(F.col("mass") * F.coalesce("p", F.lit(1.0))).alias("mass"))
    return out
