import random

import pytest

from cellweave.llm import toxicity


def slow_segments(s):
    """By definition: split at the best contiguous part of each stretch, again and again."""

    def go(a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > 0 and (best is None or t > best[2] + 1e-12):
                    best = (i, j + 1, t)
        return [] if best is None else go(a, best[0]) + [best] + go(best[1], b)

    return go(0, len(s))


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.uniform(-2, 1.5) for _ in range(rng.randrange(25))]
        got, want = toxicity.maximal_segments(s), slow_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 150))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(("Foul!", "vile", "nasty.")))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_hostile_rows(spark, corpus):
    train = spark.createDataFrame([(t, y) for i, t, y in corpus if i % 3], "text string, label int").repartition(3)
    model = toxicity.fit(train)
    held = [(i, t) for i, t, _ in corpus if i % 3 == 0] + [(None, "vile nasty"), (9000, None), (9001, ""), (9002, "w1 " * 30000 + "vile nasty foul"), (9003, "w1"), (9003, "w1")]
    docs = spark.createDataFrame([(*r, 0.0) for r in held], "doc_id long, text string, score double").repartition(3)
    rows = toxicity.toxic_passages(docs, model).collect()
    assert len(rows) == len(held)
    got = {r.doc_id: r for r in rows}
    truth = {i: y for i, _, y in corpus}
    assert sum((got[i].score >= 0.7) == truth[i] for i in got if i in truth) >= 0.98 * sum(i in truth for i in got)
    assert got[9002].passages and got[9002].passages[0].end > 29000
    assert got[9000].score == got[9001].score < 0.5 and not got[9001].passages and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxic_passages(docs.limit(0), model).collect() == []


def test_one_class_only(spark):
    train = spark.createDataFrame([("a b c", 0)], "text string, label int")
    for rows in (train, train.limit(0)):
        assert toxicity.fit(rows).score("a b")[0] < 0.5
