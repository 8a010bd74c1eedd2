import random

import numpy as np

from cellweave.llm import classifier


def make(n, seed):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        kind = rng.randrange(5)
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [w[0]] * len(w)
        rows.append((i, int(kind > 1), " ".join(w)))
    return rows


def test_held_out_accuracy_and_hostile_rows(spark):
    model = classifier.fit(spark.createDataFrame(make(400, 1), "doc_id long, label int, text string").repartition(3))
    held = make(200, 2)
    rows = [(i, t) for i, _, t in held] + [(900, None), (901, ""), (None, "x"), (902, "word1 " * 40000), (903, "a"), (903, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = classifier.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert sum((by[i] >= 0.5) == y for i, y, _ in held) >= 196
    assert by[900] == by[901] == model.prior and by[902] < 0.5
    assert classifier.classify(docs.limit(0), model).collect() == []


def test_votes_equal_brute_force():
    rows = make(80, 3)
    x = classifier.matrix([classifier.terms(t) for _, _, t in rows])
    rng = np.random.default_rng(0)
    model = classifier.Model(np.ones(classifier.DIMS, np.float32), rng.normal(size=(classifier.DIMS, 8)).astype(np.float32), np.zeros((0, 8)), np.array([y for _, y, _ in rows]), 0.5)
    model.vectors = model.embed(x)
    new = [t for *_, t in make(150, 4)]
    for t, got in zip(new, model.score(new)):
        v = classifier.matrix([classifier.terms(t)])[0] @ model.directions
        c = np.array([v @ u / np.linalg.norm(v) / np.linalg.norm(u) for u in model.vectors])
        near = np.argsort(-c)[: classifier.NEIGHBOURS]
        w = np.maximum(c[near], 0) ** 4
        assert abs(got - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_no_labels(spark):
    model = classifier.fit(spark.createDataFrame([], "doc_id long, label int, text string"))
    assert model.score(["a", None]).tolist() == [0.5, 0.5]
