"""The queries that other tests do not call, on small tables: folds, thresholds, columns, and the models behind them
against plain loops."""

import math
import random
import zlib

import numpy as np
import pytest

from cellweave.llm import classifier, quality, sentencepieces, simhash, toxicity
from tests.llm.test_quality import slow as slow_counts
from tests.llm.test_simhash import slow_components
from tests.llm.test_toxicity import slow_segments


def fold(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randrange(50, 90))]
        toxic, good = i % 6 == 0, i % 4 > 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("Foul!", "vile", "nasty.")))
        if not good:
            w = [x + " |" for x in w]
        docs.append((i, " ".join(w), rng.choice(("en", "de", None)), "s"))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    docs += [(2000, None, "en", "s"), (2001, "", "en", "s"), (None, "vile w1", "en", "s"), (5, "another text of the same id", "en", "s"), (2002, docs[3][1], "de", "s")]
    labels += [(None, 1, 1), (7, 0, None), (9999, 1, 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs, labels


def training(docs, labels, mark):
    """[(doc_id, label, text)]: labelled rows of the training folds, one an id, of several texts the least."""
    votes = {}
    for d, q, t in labels:
        value = q if mark == "quality" else t
        if d is not None and value is not None:
            votes.setdefault(d, []).append(value)
    texts = {}
    for d, t, *_ in docs:
        if d is not None:
            texts[d] = min(texts.get(d, t or ""), t or "")
    return [(d, int(sum(v) / len(v) >= 0.5), texts[d]) for d, v in sorted(votes.items()) if d in texts and fold(d, 3) != 1]


def rows_of(found):
    return sorted(((-1 if r.doc_id is None else r.doc_id), *r[1:]) for r in found.collect())


def test_toxicity(spark, corpus):
    at, docs, labels = corpus
    rows = training(docs, labels, "toxic")
    y, n, kinds = {}, [0, 0], set()
    for _, label, t in rows:
        for token in set(toxicity.tokens(t)):
            y.setdefault(token, [0, 0])[label] += 1
            n[label] += 1
            kinds.add(token)
    want, total = {}, 500 + 0.5 * len(kinds)
    for token, (y0, y1) in y.items():
        s = 0.5 + 500 * (y0 + y1) / sum(n)
        d = math.log((y1 + s) / (n[1] + total - y1 - s)) - math.log((y0 + s) / (n[0] + total - y0 - s))
        se = math.sqrt(1 / (y1 + s) + 1 / (y0 + s))
        if y0 + y1 >= 3 and abs(d) >= 2.5 * se:
            want[token] = math.copysign(max(0.0, abs(d) - se), d)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert model.scores.keys() == {t for t, x in want.items() if x} and {"foul", "vile", "nasty"} <= model.scores.keys()
    assert all(abs(model.scores[t] - x) < 1e-9 for t, x in want.items() if x)
    found = toxicity.op3_toxicity(spark, at)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = rows_of(found.select("doc_id", "held_out", "score", "predicted"))
    expected = sorted(((-1 if d is None else d), fold(d, 3) == 1, model.score(t)[0], int(model.score(t)[0] >= 0.7)) for d, t, *_ in docs)
    assert [x[:2] for x in got] == [x[:2] for x in expected] and all(abs(a[2] - b[2]) < 1e-6 and a[3] == b[3] for a, b in zip(got, expected))


def test_toxicity_by_plain_loops(spark, corpus):
    """lambda, K, the calibration and every row's score, with segments by definition."""
    at, docs, labels = corpus
    rows = training(docs, labels, "toxic")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    clean, total = {}, 0
    for _, label, t in rows:
        if not label:
            own = set(toxicity.tokens(t))
            total += len(own)
            for token in own & model.scores.keys():
                clean[token] = clean.get(token, 0) + 1
    share = {t: (clean.get(t, 0) + 0.5) / (total + 0.5 * len(model.scores) + 1) for t in model.scores}
    rest = 1 - sum(share.values())
    moment = lambda x: sum(p * math.exp(x * (model.scores[t] - 1)) for t, p in share.items()) + rest * math.exp(-x)
    assert model.fee == 1 and model.lam > 0 and moment(model.lam * (1 - 1e-6)) < 1 < moment(model.lam * (1 + 1e-6))

    def segments(t):
        return slow_segments([model.scores.get(w, 0.0) - 1 for w in toxicity.tokens(t)])

    n_clean, expected = 0, 0.0
    for _, label, t in rows:
        if not label and toxicity.tokens(t):
            n_clean += 1
            expected += len(toxicity.tokens(t)) * math.exp(-model.lam * max((x for *_, x in segments(t)), default=0.0))
    assert abs(model.k - n_clean / expected) < 1e-6 * model.k

    def evidence(t):
        n, out = len(toxicity.tokens(t)), 0.0
        for *_, x in segments(t):
            e_value = model.k * n * math.exp(-model.lam * x)
            if e_value < 0.05:
                out -= math.log(e_value)
        return math.log1p(out)

    # slope and intercept are where the penalised likelihood of classes of like weight is level
    sizes = [sum(label == c for _, label, _ in rows) for c in (0, 1)]
    slope = [-1e-2 * model.a, -1e-2 * model.b]
    for _, label, t in rows:
        x = evidence(t)
        off = 0.5 * len(rows) / sizes[label] * ((0.999 if label else 0.001) - 1 / (1 + math.exp(-(model.a * x + model.b))))
        slope = [slope[0] + off * x, slope[1] + off]
    assert model.a > 0 and max(map(abs, slope)) < 1e-3
    found = toxicity.op3_toxicity(spark, at)
    want = sorted(((-1 if d is None else d), 1 / (1 + math.exp(-(model.a * evidence(t) + model.b)))) for d, t, *_ in docs)
    for got, (d, score) in zip(rows_of(found.select("doc_id", "score", "predicted")), want, strict=True):
        assert got[0] == d and abs(got[1] - score) < 1e-6 and got[2] == (score >= 0.7)


def test_quality_classifier(spark, corpus):
    at, docs, labels = corpus
    rows = training(docs, labels, "quality")
    x = classifier.matrix([classifier.terms(t) for *_, t in rows]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    _, _, vt = np.linalg.svd(x * idf, full_matrices=False)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    known, y = unit((x * idf) @ vt[: classifier.RANK].T), np.array([label for _, label, _ in rows])
    new = unit((classifier.matrix([classifier.terms(t) for _, t, *_ in docs]) * idf) @ vt[: classifier.RANK].T) @ known.T
    found = classifier.op9_quality_classifier(spark, at)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got, want = rows_of(found), []
    for (d, t, *_), c in zip(docs, new):
        near = np.argsort(-c, kind="stable")[: classifier.NEIGHBOURS]
        w = np.maximum(c[near], 0) ** 4
        score = (w * y[near]).sum() / w.sum() if w.sum() > 1e-9 else y.mean()
        want.append(((-1 if d is None else d), fold(d, 3) == 1, score))
    want.sort()
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(r[3] == (r[2] >= 0.5) for r in got)
    # vectors are in single precision, so neighbours that are nearly as near may change places
    assert np.mean([abs(a[2] - b[2]) < 0.02 for a, b in zip(got, want)]) > 0.98


def test_ties_go_to_the_first():
    model = classifier.Model(np.ones(classifier.DIMS, np.float32), np.eye(classifier.DIMS, 8, dtype=np.float32), np.zeros((0, 8)), np.array([1] * classifier.NEIGHBOURS + [0] * 90), 0.5)
    v = np.zeros(8, np.float32)
    v[0] = 1
    model.vectors = np.tile(v, (classifier.NEIGHBOURS + 90, 1))
    model.embed = lambda x: np.tile(v, (len(x), 1))
    assert model.score(["a"]).tolist() == [1.0]


def test_quality_rules(spark, corpus):
    at, docs, labels = corpus
    good = {d: y for d, y, _ in labels if d is not None}
    good[7] = int((good[7] + 1) / 2 >= 0.5)
    held = {}
    for d, t, lang, _ in docs:
        if d in good:
            row = (lang or "", *quality.measure(t)[5:])
            held[d] = min(held.get(d, row), row)
    names, share = list(quality.RULES), 0.02 / len(quality.RULES)
    strata = {s: [d for d, r in held.items() if r[0] == s] for s in {r[0] for r in held.values()}}
    enough = {s: sum(good[d] for d in ids) for s, ids in strata.items()}
    enough = {s: n for s, n in enough.items() if n >= quality.least_holdouts(share, 0.05)}
    cuts = {}
    for s, n in enough.items():
        for k, rule in enumerate(names):
            best = None
            for cut in quality.RULES[rule]:
                out = [good[d] for d in strata[s] if held[d][k + 1] > cut]
                tail = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(sum(out) + 1))
                if tail > 0.05 / (len(names) * len(enough)):
                    break
                if out.count(0) and (best is None or out.count(0) > best[0]):
                    best = (out.count(0), cut)
            if best:
                cuts[s, rule] = best[1]
    found = quality.op5_quality_rules(spark, at)
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = []
    for d, t, lang, _ in docs:
        n, chars, symbols, dup, repeat = slow_counts(t)
        failed = n < 50 or 100 * repeat > 50 * n
        hits = [r for r, x in zip(names, quality.measure(t)[5:]) if x > cuts.get((lang or "", r), math.inf)]
        want.append(((-1 if d is None else d), n, chars, symbols, dup, repeat, failed, not failed and not hits, ",".join(hits)))
    assert rows_of(found) == sorted(want)


def test_simhash_and_sentencepieces(spark, corpus):
    at, docs, _ = corpus
    few = [(d, t) for d, t, *_ in docs if d is not None and d != 5]
    found = simhash.op4_simhash(spark, at)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: r for r in found.collect()}
    for d, fp, comp in slow_components(few[:200]):
        assert got[d].fingerprint == fp and got[d].component_id == comp
    assert got[3].component_id == got[2002].component_id == 3 and got[2000].fingerprint == "0" * 16 and got[2001].component_id == 2000
    tokens = sentencepieces.op2_sentencepiece(spark, at)
    assert tokens.columns[:2] == ["doc_id", "ids"] and tokens.count() == len(docs) and tokens.where("not exact").count() == 0


def slow_ids(codec, worth, text):
    """Viterbi over a whole text, character by character, in whole numbers; of equal sums the longer last piece."""
    raw = " " + text if text else ""
    best = [(0, 0, ())] + [None] * len(raw)
    longest = max(map(len, worth))
    for end in range(1, len(raw) + 1):
        for begin in range(max(0, end - longest), end):
            part = raw[begin:end]
            if part in worth:
                value, ids = worth[part]
            elif end - begin == 1:
                value, ids = int(codec.unknown * 2**60), tuple(int(codec.byte_ids[x]) for x in part.encode())
            else:
                continue
            total = best[begin][0] + value
            if best[end] is None or total > best[end][0]:
                best[end] = (total, begin, ids)
    out, at = [], len(raw)
    while at:
        _, before, ids = best[at]
        out[:0] = ids
        at = before
    return out


def test_sentencepieces_by_a_slow_viterbi(spark, tmp_path):
    """Every id of the query's rows."""
    rng = random.Random(4)
    parts = ["the ", "of", "ing ", "tion", " é", "ñ", "漢字", "🎉", "  ", "\n", "x", "Q", "1234 ", "hello", " World", "\u2581", "\u200b", "encoding ", "    "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(150)] + [(None, "a b"), (500, None), (501, " "), (502, "the  of " * 300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    codec = sentencepieces.Codec()
    worth = {codec.text[i].decode(): (int(float(x) * 2**60), (int(i),)) for i, x in zip(codec.ids.tolist(), codec.scores.tolist())}
    found = sentencepieces.op2_sentencepiece(spark, str(tmp_path)).collect()
    want = {d: slow_ids(codec, worth, t or "") for d, t in docs}
    bytes_of = set(map(int, codec.byte_ids))
    assert len(found) == len(docs)
    for r in found:
        assert list(r.ids) == want[r.doc_id]
        assert r.n_tokens == len(r.ids) and r.n_bytes == sum(i in bytes_of for i in r.ids) and r.exact
