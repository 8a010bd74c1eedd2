import hashlib
import random

from cellweave.llm import mixing


def slow_rake(cells, targets, rounds):
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(rounds):
        for m in range(3):
            sums = {}
            for c, t in cells.items():
                sums[c[m]] = sums.get(c[m], 0) + t * factor[c]
            for c in cells:
                factor[c] *= targets[m][c[m]] / sums[c[m]] if sums[c[m]] else 0
    return factor


def slow_bounded_rake(cells, targets, rounds, keep):
    """Probabilities: the same with no factor over 1, and a step for the sum after each round."""
    mass = keep * sum(cells.values())
    factor = dict.fromkeys(cells, keep)
    for _ in range(rounds):
        for m in (0, 1, 2, None):
            sums = {}
            for c, t in cells.items():
                k = None if m is None else c[m]
                sums[k] = sums.get(k, 0) + t * factor[c]
            for c in cells:
                k = None if m is None else c[m]
                target = 1.0 if m is None else targets[m][k]
                factor[c] = min(1.0, factor[c] * target * mass / sums[k]) if sums[k] else 0.0
    return factor


def make(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["s1", "s2", "s3"])
        rows.append((i, rng.choice(("a b c", "a | b | c | d", "call 12345 now", "The License says")) + " x" * rng.randrange(30), rng.choice(("en", "en", "de")), source))
    return rows + [(900, None, "en", "hot"), (901, "", None, None), (902, "x " * 20000, None, "s1"), (None, "q r", "de", None), (903, "x y", "en", "s2"), (903, "x y", "en", "s2")]


def test_equals_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, weight int").repartition(3)
    got = mixing.mix(docs, keep=0.5, rounds=8, calibrated=False).collect()
    assert len(got) == len(rows)
    cells, targets = {}, []
    for r in got:
        assert r.tokens == len((dict((a, b) for a, b, *_ in rows)[r.doc_id] or "").split())
        if r.tokens:
            cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    for m in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        total = sum(t**0.7 for t in sums.values())
        targets.append({k: t**0.7 / total for k, t in sums.items()})
    want, everything = slow_rake(cells, targets, 8), sum(cells.values())
    for r in got:
        w = want[r.source, r.lang, r.topic] * everything if r.tokens else 0.0
        assert abs(r.weight - w) < 1e-4 * max(1, w)
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) / 2**52
        assert r.selected == (u < min(1, r.probability))
    for m in range(3):
        for k, t in targets[m].items():
            own = sum(r.tokens * r.weight for r in got if (r.source, r.lang, r.topic)[m] == k)
            assert abs(own / everything - t) < (0.02, 0.02, 1e-6)[m]


def test_many_cells_are_raked_alike(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, x, t, rng.randrange(1, 90)) for s in "abcd" for x in ("en", "de") for t in ("prose", "table")], "source string, lang string, topic string, tokens long")
    targets = {m: mixing.tempered_targets(cells, m, 0.5) for m in mixing.MARGINS}
    few, many = ({tuple(r)[:3]: r.factor for r in mixing.rake(cells, targets, 3, few=n).collect()} for n in (100, 1))
    assert few.keys() == many.keys() and all(abs(few[k] / many[k] - 1) < 1e-9 for k in few)


def test_given_targets_and_sample(spark):
    rows = [r for r in make() if r[0] != 902]  # a single huge cell slows raking down
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    even = {m: spark.createDataFrame([(k, 1 / len(ks)) for k in ks], f"{m} string, target double") for m, ks in (("source", ["hot", "s1", "s2", "s3", ""]), ("lang", ["en", "de", ""]), ("topic", ["prose", "table", "figures", "notice"]))}
    found = mixing.mix(docs, even, rounds=12, calibrated=False).collect()
    mass = sum(r.tokens * r.weight for r in found)
    assert abs(sum(r.tokens * r.weight for r in found if r.source == "hot") / mass - 0.2) < 0.02
    kept = mixing.sample(docs, rounds=2)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in mixing.mix(docs, rounds=2).collect() if r.selected)
    assert kept.columns == docs.columns and 30 < kept.count() < len(rows)
    assert mixing.mix(docs.limit(0), rounds=2).collect() == [] and mixing.sample(docs.limit(0), rounds=2).collect() == []
    empty = spark.createDataFrame([(1, None, None, None)], docs.schema)
    assert [r.selected for r in mixing.mix(empty, rounds=2).collect()] == [False]


def shares(found, column):
    mass = sum(r.tokens * r[column] for r in found)
    out = {}
    for at, m in enumerate(mixing.MARGINS):
        for r in found:
            out[m, r[m]] = out.get((m, r[m]), 0.0) + r.tokens * r[column] / mass
    return out


def test_bounded_raking_equals_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, keep=0.6, rounds=9).collect()
    cells, targets = {}, []
    for r in got:
        if r.tokens:
            cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    for m in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        targets.append({k: t**0.7 / sum(x**0.7 for x in sums.values()) for k, t in sums.items()})
    want = slow_bounded_rake(cells, targets, 9, 0.6)
    assert max(want.values()) == 1.0
    for r in got:
        assert abs(r.probability - (want[r.source, r.lang, r.topic] if r.tokens else 0.0)) < 1e-9 and abs(r.probability - 0.6 * r.weight) < 1e-9


def test_targets_are_met_where_there_are_tokens_enough(spark):
    """Saturated cells leave their share to others of their category; cutting them at the end does not."""
    rng = random.Random(2)
    rows = [(i, "w " * 20, "en" if rng.random() < 0.9 else "de", rng.choice(("s1", "s1", "s1", "s2"))) for i in range(3000)]
    rows = [(i, t, "de" if s == "s2" and rng.random() < 0.02 else x, s) for i, t, x, s in rows] + [(9000 + i, "w " * 20, "de", "s3") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    even = {"source": spark.createDataFrame([("s1", 0.6), ("s2", 0.39), ("s3", 0.01)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.85), ("de", 0.15)], "lang string, target double"), "topic": spark.createDataFrame([("prose", 1.0)], "topic string, target double")}
    got = mixing.mix(docs, even, keep=0.6, rounds=60).collect()
    own = shares(got, "probability")
    for m, t in even.items():
        for r in t.collect():
            assert abs(own[m, r[m]] - r.target) < 1e-3
    assert max(r.probability for r in got) == 1.0 and abs(sum(r.tokens * r.probability for r in got) / sum(r.tokens for r in got) - 0.6) < 1e-6


def test_a_rare_source_does_not_lower_what_is_kept(spark):
    """One document of a source and a language of its own: it is kept, and half of the tokens are."""
    rows = [r for r in make(2000) if r[0] != 902]
    for more in ([], [(7000, "only one here", "xx", "rare")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        got = mixing.mix(docs).collect()
        everything = sum(r.tokens for r in got)
        assert abs(sum(r.tokens * r.probability for r in got) / everything - 0.5) < 0.005
    assert next(r.probability for r in got if r.doc_id == 7000) == 1.0
    # what the rare one can't give, the others share as their targets do
    raw, own = {}, shares(got, "probability")
    for r in got:
        raw[r.source] = raw.get(r.source, 0) + r.tokens
    ratio = {k: own["source", k] / t**0.7 for k, t in raw.items() if k not in ("rare", "")}
    assert max(ratio.values()) / min(ratio.values()) < 1.02
    assert sum(r.tokens * r.probability for r in mixing.mix(docs, keep=0.01, rounds=2).collect()) / everything < 0.011


def test_columns_of_any_name_stay(spark):
    names = ["_own", "_in", "weight", "probability", "selected", "topic", "tokens", "mix_tokens", "key_lang", "factor", "a.b"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in make(60)], f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` int' for n in names)}")
    kept = mixing.sample(docs, rounds=2)
    assert kept.columns == docs.columns
    chosen = {m.doc_id for m in mixing.mix(docs, rounds=2).collect() if m.selected}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id in chosen)


def test_shortfall_says_which_targets_are_missed(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 10), ("b", "de", "prose", 30)], "source string, lang string, topic string, tokens long")
    share = lambda m, **x: spark.createDataFrame(list(x.items()), f"{m} string, target double")
    targets = {"source": share("source", a=0.5, b=0.5), "lang": share("lang", en=0.2, de=0.8), "topic": share("topic", prose=1.0)}
    found = {(r.margin, r.category): (r.target, round(r.share, 6)) for r in mixing.shortfall(mixing.rake(cells, targets, 2), targets).collect()}
    assert found["lang", "en"] == (0.2, 0.2) and found["source", "a"] == (0.5, 0.2)  # source and language go together


def test_the_query(spark, tmp_path):
    rows = make(100)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.op1_mixing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected"]
    got = found.collect()
    assert len(got) == len(rows) and max(r.probability for r in got) <= 1 and {r.selected for r in got} == {True, False}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(make(20), "doc_id long, text string, lang string, source string")
    plan = mixing.mix(docs, rounds=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
