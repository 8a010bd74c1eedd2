"""Networks and logic inside Spark SQL."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import local, structure
from cellweave.plans.frames import Models
from cellweave.sources import spark as sources
from cellweave.sources.fixtures import NETWORKS
from cellweave.sources.text import write_an, write_anx


@pytest.fixture(scope="module")
def session(spark):
    sources.register(spark)
    return spark


def _rows(frame):
    return sorted(map(str, frame.collect()))


def test_network_files(session, tmp_path):
    names = ("cellfate", "p53-mdm2", "phasetype-demo", "multivalued-demo")
    for m in names:
        (tmp_path / f"{m}.anx").write_text(write_anx(NETWORKS[m]))
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "deep.an").write_text(write_an(NETWORKS["p53-mdm2"]))
    (tmp_path / "m.bnd").write_text("node A { logic = B; rate_up = @logic ? $u : 0; }\nnode B { logic = !A; }")
    (tmp_path / "m.cfg").write_text("$u = 2.5; A.istate = 0;")
    (tmp_path / "notes.txt").write_text("no model")
    (tmp_path / "b.bnet").write_text("targets, factors\na, !b\nb, a\n")
    load = lambda path, **o: session.read.format("network").options(**o).load(str(path))
    whole = load(tmp_path, filesPerPartition=2)
    assert {r.model_id for r in whole.select("model_id").collect()} == {*names, "m", "b"}
    assert whole.rdd.getNumPartitions() == 3 and load(f"{tmp_path}/*/*.an").first().model_id == "deep"
    assert load(f"file://{tmp_path}/c*.anx").count() == 1 and load(f"{tmp_path}/none*.anx").count() == 0
    one = load(tmp_path / "cellfate.anx").first()
    assert len(one.automata) == 11 and len(one.transitions) == 27 and one.transitions[0].dist.kind == "exp"
    from_files, from_text = Models.of_parsed(load(f"{tmp_path}/*.anx")), Models.read(session, f"{tmp_path}/*.anx")
    for part in ("automata", "transitions", "initial", "models"):
        assert _rows(getattr(from_files, part)) == _rows(getattr(from_text, part)) and getattr(from_files, part).schema == getattr(Models.of(session, {}), part).schema
    maboss = Models.of_parsed(load(tmp_path / "m.bnd"))
    assert sorted((r.automaton, r.to_level, r.rate) for r in maboss.transitions.collect()) == [("A", 0, 1.0), ("A", 1, 2.5), ("B", 0, 1.0), ("B", 1, 1.0)]
    assert structure.info(maboss).first().transitions == 4 and [tuple(r)[1:] for r in maboss.initial.collect()] == [("A", 0)]
    with pytest.raises(Exception, match="there is no"):
        load(tmp_path / "gone").count()
    (tmp_path / "bad.anx").write_text("nonsense")
    with pytest.raises(Exception):
        load(tmp_path / "bad.anx").count()


def test_texts_are_parsed_once(session):
    """Each row of texts is parsed in one task, once, whatever is asked of the models afterwards."""
    parsed = session.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            parsed.add(len(batch))
            yield batch

    texts = session.createDataFrame([(f"m{k}", "anx", "automaton a [2]\na: 0 -> 1\ninit a=0") for k in range(30)], "model_id string, format string, text string")
    models = Models.from_texts(texts.mapInPandas(count, texts.schema))
    assert [getattr(models, part).count() for part in ("automata", "transitions", "initial", "models")] == [30] * 4 and parsed.value == 30
    assert Models.from_texts(texts.limit(0)).transitions.isEmpty()
    packed = session.createDataFrame([("a", "anx", "automaton a [2]", "x")], "model_id string, format string, text string, clash string")
    assert Models.from_texts(packed).automata.count() == 1


def test_dnf_in_sql(session):
    rules = session.createDataFrame([("and", "a & !b"), ("or", "!(a & b)"), ("no", "a & !a"), ("yes", "TRUE"), ("null", None), ("same", "a | a")], "node string, logic string")
    got = session.sql("SELECT node, d.* FROM {rules}, LATERAL dnf(logic) d", rules=rules).collect()
    assert sorted((r.node, r.clause, r.variable, r.value) for r in got if r.node != "yes") == [("and", 0, "a", 1), ("and", 0, "b", 0), ("or", 0, "a", 0), ("or", 1, "b", 0), ("same", 0, "a", 1)]
    assert [tuple(r)[1:] for r in got if r.node == "yes"] == [(0, None, None)]
    with pytest.raises(Exception, match="parenthesis"):
        session.sql("SELECT * FROM dnf('(a')").collect()


def test_local_paths_in_sql(session):
    models = Models.of(session, {m: NETWORKS[m] for m in ("cellfate", "multivalued-demo", "p53-mdm2")})
    asked = models.automata.select("model_id", "automaton").join(models.models.select("model_id", "text"), "model_id").union(session.createDataFrame([("x", None, None), ("y", "a", "automaton b [2]")], "model_id string, automaton string, text string"))
    got = session.sql("SELECT model_id, automaton, p.source, p.target, p.path FROM {asked}, LATERAL local_paths(text, automaton) p", asked=asked)
    assert _rows(got) == _rows(local.local_paths(models).select("model_id", "automaton", "source", "target", F.col("path")))
