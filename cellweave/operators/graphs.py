"""Strong components of edge tables, however large, by rounds of joins: many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import cut
from .structure import closure


def _trimmed(edges: DataFrame, key: str, rounds: int) -> DataFrame:
    """The edges without those of nodes that nothing leads to or from, a few times over."""
    n = edges.count()
    for _ in range(rounds):
        both = edges.select(key, F.col("src").alias("node")).intersect(edges.select(key, F.col("dst").alias("node")))
        for end in ("src", "dst"):
            edges = edges.join(both.withColumnRenamed("node", end), [key, end], "left_semi")
        edges = cut(edges)
        before, n = n, edges.count()
        if n in (0, before):
            break
    return edges


def _colours(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, colour): the least node that leads to each. Only nodes whose colour fell send it on."""
    nodes = edges.select(key, F.col("src").alias("node")).union(edges.select(key, "dst")).distinct()
    colour = front = cut(nodes.withColumn("colour", F.col("node")))
    while True:
        sent = front.join(edges.withColumnRenamed("src", "node"), [key, "node"]).groupBy(key, F.col("dst").alias("node")).agg(F.min("colour").alias("better"))
        front = cut(sent.join(colour, [key, "node"]).where("better < colour").select(key, "node", F.col("better").alias("colour")))
        if front.isEmpty():
            return colour
        colour = cut(colour.join(front.withColumnRenamed("colour", "better"), [key, "node"], "left").select(key, "node", F.coalesce("better", "colour").alias("colour")))


def strong_components(edges: DataFrame, key: str = "model_id", trims: int = 3) -> DataFrame:
    """(key, node, comp) for every node of edges (key, src, dst); comp is the least node of its strong component.

    Rounds of three steps: nodes without a way in or out go; each node takes the least node that leads to it as its
    colour; what leads back to that node inside the colour is its component, and goes. A round settles a component of
    every colour. Edges and nodes stay distributed. Nulls are no nodes; self-loops and repeated edges change nothing.
    """
    given = cut(edges.select(key, "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    nodes = cut(given.select(key, F.col("src").alias("node")).union(given.select(key, "dst")).distinct())
    left = cut(given.where("src <> dst").distinct())
    done = None
    while True:
        left = _trimmed(left, key, trims)
        if left.isEmpty():
            break
        colour = _colours(left, key)
        of = lambda end: colour.select(key, F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = left.join(of("src"), [key, "src"]).join(of("dst"), [key, "dst"]).where("src_colour = dst_colour")
        back = cut(inside.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = closure(back, colour.where("node = colour").select(key, "node"), [key])
        found = cut(colour.join(reached, [key, "node"], "left_semi").select(key, "node", F.col("colour").alias("comp")))
        done = found if done is None else done.union(found)
        for end in ("src", "dst"):
            left = left.join(found.select(key, F.col("node").alias(end)), [key, end], "left_anti")
        left = cut(left)
    if done is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(done, [key, "node"], "left").select(key, "node", F.coalesce("comp", "node").alias("comp"))


def terminal(edges: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, node, comp) of the nodes in strong components that no edge leaves."""
    parts = cut(strong_components(edges, key))
    of = lambda end: parts.select(key, F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    leaving = edges.join(of("src"), [key, "src"]).join(of("dst"), [key, "dst"]).where("src_comp <> dst_comp").select(key, F.col("src_comp").alias("comp")).distinct()
    return parts.join(leaving, [key, "comp"], "left_anti").select(key, "node", "comp")


def circuits(signed: DataFrame, key: str = "model_id", most: int = 5_000_000) -> DataFrame:
    """(key, nodes, sign, truncated): elementary cycles of edges (key, src, dst, sign), as structure.circuits() gives them,
    by rounds of joins.

    Only edges inside a strong component are walked. A way goes out from its least node over greater ones; ways from one
    node to another over the same nodes with the same sign are one row, so that rows go with sets of nodes, not with
    their orders. Each round adds one node to every way and is written. They may still be exponentially many: a graph
    with more than `most` ways in one round is given up, and all its rows say truncated (one row without nodes where it
    had found none). Rows with nulls are no edges, repeated ones count once. No edges: no rows.
    """
    given = signed.select(key, "src", "dst", F.col("sign").cast("int").alias("sign")).dropna().distinct()
    parts = strong_components(given, key)
    of = lambda end: parts.select(key, F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    inside = cut(given.join(of("src"), [key, "src"]).join(of("dst"), [key, "dst"]).where("src_comp = dst_comp").select(key, "src", "dst", "sign"))
    step = inside.where("src <> dst").select(key, F.col("src").alias("at"), "dst", F.col("sign").alias("more"))
    found = [inside.where("src = dst").select(key, F.array("src").alias("nodes"), "sign")]
    given_up = []
    front = cut(inside.where("dst > src").select(key, F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("nodes"), "sign"))
    while not front.isEmpty():
        ways = front.join(step, [key, "at"]).where("dst = start OR dst > start AND NOT array_contains(nodes, dst)")
        ways = ways.select(key, "start", F.col("dst").alias("at"), F.when(F.col("dst") == F.col("start"), F.col("nodes")).otherwise(F.array_sort(F.array_append("nodes", F.col("dst")))).alias("nodes"), (F.col("sign") * F.col("more")).alias("sign"))
        ways = cut(ways.distinct())
        found.append(ways.where("at = start").select(key, "nodes", "sign"))
        front = ways.where("at <> start")
        over = cut(front.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key))
        if not over.isEmpty():
            given_up.append(over)
            front = front.join(over, key, "left_anti")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    rows = rows.select(key, F.array_join("nodes", ",").alias("nodes"), "sign").distinct()
    if not given_up:
        return rows.withColumn("truncated", F.lit(False))
    ended = given_up[0]
    for more in given_up[1:]:
        ended = ended.union(more)
    ended = ended.withColumn("ended", F.lit(True))
    return rows.join(ended, key, "full_outer").select(key, "nodes", "sign", F.coalesce("ended", F.lit(False)).alias("truncated"))
