"""Networks and chains derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import structure
from .frames import Models
from .staging import cut


def consecutive(rows: DataFrame, keys: list[str], block: Column, order: list[str], carry: list[str]) -> DataFrame:
    """(keys, one, two): each row of a key and the one after it, as structs of the order, the carried columns and the
    block. Rows go by order, ties by what is carried; nulls come first.

    block must not fall along the order. Rows meet by key and block, so that a busy key is many small groups; each
    block's last row is then joined to the first of the key's next block, from one row a key and block.
    """
    r = rows.select(*keys, F.struct(*order, *carry, block.alias("block")).alias("one"))
    within = W.partitionBy(*keys, "one.block").orderBy("one")
    inside = r.withColumn("two", F.lead("one").over(within)).where("two IS NOT NULL")
    return inside.union(seams(block_ends(r, keys), keys))


def block_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, first, last) of rows (keys, one), the struct of consecutive()."""
    return rows.groupBy(*keys, F.col("one.block").alias("block")).agg(F.min("one").alias("first"), F.max("one").alias("last"))


def seams(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, one, two): the last row of each block and the first of the key's next block."""
    ahead = F.lead("first").over(W.partitionBy(*keys).orderBy("block"))
    return ends.withColumn("two", ahead).where("two IS NOT NULL").select(*keys, F.col("last").alias("one"), "two")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def event_jumps(events: DataFrame, per_user: bool = False) -> DataFrame:
    """(model_id, src, dst, n, us): how often an event of one type is followed by one of another, and after how many
    microseconds in all; over all users, or for each one.

    A user's events in order of (ts, event_id), in blocks of an hour: see consecutive(). Events without a time count
    for nothing, those without a type part what is before and after them.
    """
    e = events.select("user_id", "event_id", "event_type", micros("ts").alias("us")).where("us IS NOT NULL")
    pairs = consecutive(e, ["user_id"], F.expr("us div 3600000000"), ["us", "event_id"], ["event_type"])
    pairs = pairs.where("one.event_type IS NOT NULL AND two.event_type IS NOT NULL")
    return pairs.groupBy(_model(per_user), F.col("one.event_type").alias("src"), F.col("two.event_type").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("two.us") - F.col("one.us")).alias("us"))


def _model(per_user: bool):
    return (F.concat(F.lit("u"), F.col("user_id").cast("string")) if per_user else F.lit("events")).alias("model_id")


def event_chain(events: DataFrame, per_user: bool = False) -> DataFrame:
    """(model_id, src, dst, rate): one chain of event types, or one a user; rate i -> j is the number of jumps over
    the seconds spent in i."""
    stay = F.sum("us").over(W.partitionBy("model_id", "src"))
    return event_jumps(events, per_user).withColumn("stay", stay).where("stay > 0").select("model_id", "src", "dst", (F.col("n") * 1e6 / F.col("stay")).alias("rate"))


def user_networks(events: DataFrame) -> Models:
    """A Boolean network for each user with two events or more: an automaton a type of event, regulated by the other
    type that most often comes just before it (of several the first by name).

    The regulator raises it where it comes before it at least as often as after it, else it lowers it. All rates are
    1; the type of the user's first event starts at 1, the others at 0.
    """
    jumps = cut(event_jumps(events, per_user=True).select("model_id", "src", "dst", "n"))
    both = jumps.select("model_id", F.col("src").alias("automaton")).union(jumps.select("model_id", F.col("dst").alias("automaton"))).distinct()
    automata = cut(both.withColumn("levels", F.lit(2)))
    order = W.partitionBy("model_id", "dst").orderBy(F.desc("n"), "src")
    first = jumps.where("src <> dst").withColumn("r", F.row_number().over(order)).where("r = 1")
    back = jumps.select("model_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("m"))
    signed = first.join(back, ["model_id", "src", "dst"], "left").withColumn("up", (F.col("n") >= F.coalesce("m", F.lit(0))).cast("int"))
    moves = signed.select("model_id", F.col("dst").alias("automaton"), "src", "up", F.explode(F.array(F.lit(0), F.lit(1))).alias("from_level"))
    tid = F.row_number().over(W.partitionBy("model_id").orderBy("automaton", "from_level")) - 1
    level = F.when(F.col("from_level") == 0, F.col("up")).otherwise(1 - F.col("up"))
    law = F.struct(F.lit("exp").alias("kind"), F.lit(1).alias("phases"), F.array(F.lit(1.0)).alias("rates"))
    guard = F.array(F.struct(F.col("src").alias("automaton"), level.cast("int").alias("level")))
    transitions = cut(moves.select("model_id", tid.cast("int").alias("tid"), "automaton", "from_level", (1 - F.col("from_level")).alias("to_level"), guard.alias("conditions"), law.alias("dist"), F.lit(1.0).alias("rate")))
    begun = events.where("ts IS NOT NULL AND event_type IS NOT NULL").groupBy(_model(True)).agg(F.min(F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id", "event_type"))["event_type"].alias("begun"))
    initial = cut(automata.join(begun, "model_id").select("model_id", "automaton", (F.col("automaton") == F.col("begun")).cast("int").alias("level")))
    named = automata.select("model_id").distinct().select("model_id", F.lit("").alias("name"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("text"))
    return structure.with_texts(Models(automata, transitions, initial, named))


def trade_graph(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame, nation: DataFrame, top: int = 2) -> DataFrame:
    """(model_id, src, dst, sign, revenue): supplier's nation to customer's nation, the `top` partners by revenue each.

    sign: 1 where the mean discount is at least the one over all, else -1. The line items are aggregated before any
    dimension's name is looked up.
    """
    li = lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    pairs = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").where("sn <> cn").groupBy("sn", "cn").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    mean = F.sum("d").over(every) / F.sum("n").over(every)
    best = pairs.withColumn("sign", F.when(F.round(F.col("d") / F.col("n"), 9) >= F.round(mean, 9), 1).otherwise(-1)).withColumn("r", F.row_number().over(W.partitionBy("sn").orderBy(F.desc("revenue"), "cn"))).where(F.col("r") <= top)
    name = lambda k: nation.select(F.col("n_nationkey").alias(k), F.trim("n_name").alias(f"{k}_name"))
    return best.join(name("sn"), "sn").join(name("cn"), "cn").select(F.lit("trade").alias("model_id"), F.col("sn_name").alias("src"), F.col("cn_name").alias("dst"), "sign", "revenue")


def order_moves(orders: DataFrame) -> DataFrame:
    """(src, dst, pri, n): changes of status between a customer's consecutive orders, guarded by the first one's priority."""
    block = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    pairs = consecutive(orders, ["o_custkey"], block, ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    moves = pairs.select(F.col("one.o_orderstatus").alias("src"), F.col("two.o_orderstatus").alias("dst"), F.col("one.o_orderpriority").alias("pri"))
    return moves.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst", "pri").agg(F.count(F.lit(1)).alias("n"))
