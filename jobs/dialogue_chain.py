"""Dialogue chain: a Markov chain of dialogue states from logged conversations, and the chance of an answered end.

A turn's state is its role and how its text ends. The chain's jumps, their probabilities, and from each state the
probability that the conversation ends with an answer are what a network model of dialogues is calibrated on.

    python -m jobs.dialogue_chain SOURCE OUT --config jobs/dialogue_chain.json
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import chains
from cellweave.plans import derive

from .common import command, log, settings

DEFAULTS = {"conversation": "conv_id", "turn": "turn", "role": "role", "text": "text", "answer": "assistant", "turns_per_block": 1000, "digits": 6}
START, ANSWERED, OPEN = "start", "end:answered", "end:open"
SPACES = " \t\n\x0b\x0c\r"


def state(role: Column, text: Column) -> Column:
    """'user?', 'user.' or 'user-': the role and whether the text asks, tells, or is blank. A null role is 'none'."""
    bare = F.rtrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.concat(F.coalesce(role, F.lit("none")), F.when(bare == "", "-").when(F.right(bare, F.lit(1)) == "?", "?").otherwise("."))


def jumps(turns: DataFrame, s: dict) -> DataFrame:
    """(src, dst, n): jumps between the states of consecutive turns, from START to a first and from a last to an end.

    Turns go by number, nulls first, ties by state. Rows without a conversation are left out. A long conversation is
    many blocks of turns; jumps are counted before they are shuffled.
    """
    name = lambda k: F.col(f"`{s[k]}`")
    rows = turns.select(name("conversation").alias("conv"), name("turn").cast("long").alias("turn"), state(name("role"), name("text")).alias("state")).where("conv IS NOT NULL")
    block = F.call_function("div", F.col("turn"), F.lit(int(s["turns_per_block"])))
    pairs = derive.consecutive(rows, ["conv"], F.when(F.col("turn") < 0, block - 1).otherwise(block), ["turn"], ["state"])
    inner = pairs.select(F.col("one.state").alias("src"), F.col("two.state").alias("dst"))
    each = rows.groupBy("conv").agg(F.min(F.struct("turn", "state"))["state"].alias("first"), F.max(F.struct("turn", "state"))["state"].alias("last"))
    ends = each.select(F.lit(START).alias("src"), F.col("first").alias("dst")).union(each.select("last", F.when(F.col("last").startswith(s["answer"]), ANSWERED).otherwise(OPEN)))
    return inner.union(ends).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def run(spark: SparkSession, source: str, out: str, config: str | None = None) -> DataFrame:
    """Write to out, by src: (src, dst, n, p, answered) of the conversations at `source`. p: the chance to jump from src to
    dst next; answered: the chance that a conversation in src ends with an answer. A run replaces all of out."""
    s = settings(spark, config, DEFAULTS)
    turns = spark.read.parquet(source)
    log.info("%s: %d turns read", source, turns.count())
    edges = jumps(turns, s).select(F.lit("dialogue").alias("model_id"), "src", "dst", F.col("n").cast("double").alias("rate"))
    goal = spark.createDataFrame([("dialogue", ANSWERED)], "model_id string, node string")
    chance = chains.absorption(edges, goal).select(F.col("node").alias("src"), F.round("prob", s["digits"]).alias("answered"))
    rows = chains.jump_chain(edges).join(chance, "src").select("src", "dst", F.col("rate").cast("long").alias("n"), F.round("p", s["digits"]).alias("p"), "answered")
    # a handful of rows a state: one file each
    rows.repartition("src").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("src").parquet(out)
    found = spark.read.schema("dst string, n long, p double, answered double, src string").parquet(out)
    log.info("%s: %d jumps written", out, found.count())
    return found.select("src", "dst", "n", "p", "answered")


def main(argv: list[str] | None = None) -> None:
    command(__doc__, run, argv)


if __name__ == "__main__":
    main()
