"""What rounds hand to the driver and hold in Python, and how often they compute what they are given."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import chains, graphs, runs, states, structure
from cellweave.plans import frames
from cellweave.plans.staging import cut
from cellweave.sources.fixtures import NETWORKS


def test_what_is_cut_counts_for_what_it_is_unpacked(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("user number "), (F.col("id") % 7).cast("string")).alias("model_id"), (F.col("id") % 3).alias("sid"))
    size = cut(rows.repartition(2))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 200_000 * 20  # packed they are less than a byte a row


def test_parsed_models_come_in_small_parts():
    text = "automaton a [0, 1]\na: 0 -> 1 @ 1.0\n"
    batch = pd.DataFrame({"model_id": [f"m{i}" for i in range(450)], "format": "anx", "text": text, "extra": None})
    parts = list(frames.parsed_parts(iter([batch, batch.iloc[:0], batch.iloc[:1]])))
    assert max(map(len, parts)) <= frames.AT_ONCE
    assert [x for p in parts for x in p["model_id"]] == [*batch["model_id"], "m0"]


def _counted(rows, seen):
    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema)


def test_edges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 1), ("g", 2, 3), ("g", None, 3)], "model_id string, src int, dst int")
    found = graphs.strong_components(_counted(edges, seen)).collect()
    assert sorted((r.node, r.comp) for r in found) == [(1, 1), (2, 1), (3, 3)] and seen.value == 4


def test_jumps_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    jumps = spark.createDataFrame([("m", "a", "b", 0.5), ("m", "a", "c", 0.5), ("m", "b", "a", 1.0)], "model_id string, src string, dst string, p double")
    one = lambda x: spark.createDataFrame([("m", x)], "model_id string, node string")
    found = runs.likeliest_runs(_counted(jumps, seen), one("a"), one("c"), 2).collect()
    assert [r.run for r in sorted(found, key=lambda r: r["rank"])] == [["a", "c"], ["a", "b", "a", "c"]] and seen.value == 3


def test_texts_are_made_only_where_they_are_read(spark, monkeypatch):
    def staged(df):
        raise AssertionError("texts were written")

    monkeypatch.setattr(structure, "cut", staged)
    net = NETWORKS["p53-mdm2"]
    models = structure.with_texts(frames.Models.of(spark, {"m": net}))
    assert models.models.first().text.count("automaton ") == len(net.automata)


def test_rounds_of_small_groups_are_no_rounds_of_joins(spark, monkeypatch):
    """The same masses by arrays and by joins; by arrays as many tables are written for 40 rounds as for 2."""
    jumps = spark.createDataFrame(
        [(q, m, a, b, p) for q, m in (("q1", "m"), ("q2", "m"), ("q2", "n")) for a, b, p in ((2**61 + 1, 2, 0.25), (2**61 + 1, 3, 0.75), (2, 2**61 + 1, 0.5), (2, 4, 0.5), (3, 3, 0.5), (3, 5, 0.5))],
        "query_id string, model_id string, src long, dst long, p double",
    ).repartition(3)
    start = spark.createDataFrame([("q1", "m", 2**61 + 1, 1.0), ("q2", "m", 2, 0.5), ("q2", "m", 9, 0.5), ("q2", "n", 3, 1.0), ("q3", "m", 7, 1.0)], "query_id string, model_id string, node long, mass double")
    written, cut = [], chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: written.append(df) or cut(df))
    rows = lambda df: sorted((r.mark, r.query_id, r.model_id, r.node, round(r.mass, 12)) for r in df.collect())
    fast = rows(chains.spread(jumps, start, (0, 1, 2), 0.1))
    few = len(written)
    assert fast == rows(chains.spread(jumps, start, (0, 1, 2), 0.1, largest=0)) and (2, "q1", "m", 4, 0.125) in fast and (2, "q2", "n", 3, 0.25) in fast
    assert rows(chains.spread(jumps, start, (2,), 0.1, largest=4)) == [x for x in fast if x[0] == 2]
    shared = jumps.where("query_id = 'q1'").drop("query_id")
    assert rows(chains.spread(shared, start.where("query_id = 'q1'"), (0, 1, 2), 0.1)) == [x for x in fast if x[1] == "q1"]
    written.clear()
    assert sum(r.mass for r in chains.spread(jumps, start, (40,), 0.0).where("query_id = 'q1'").collect()) == pytest.approx(1)
    assert len(written) == few


def test_starts_of_a_bracket_are_made_once(spark, monkeypatch):
    made, own = [], states.start_states
    monkeypatch.setattr(states, "start_states", lambda *a: made.append(a) or own(*a))
    goals = spark.createDataFrame([("q", "m", "p53", 1)], "query_id string, model_id string, automaton string, level int")
    assert states.bracket(frames.Models.of(spark, {"m": NETWORKS["p53-mdm2"]}), goals, (4,)).count() == 1 and len(made) == 1
