import random
import zlib
from collections import Counter

import numpy as np

from cellweave.llm import langid

SYLLABLES = {"aa": "ba ko mi ta", "bb": "sch ung ie er", "cc": "çé eau ou tion"}


def text(lang, rng, n=40):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def slow_grams(t):
    low = "".join(c if c.isalpha() else " " for c in (t or "").lower())
    count = Counter()
    for word in low.split():
        padded = f" {word} "
        count.update(word)
        count.update(padded[i : i + 2] for i in range(len(padded) - 1))
        count.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return count


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_grams_equal_brute_force():
    rng = random.Random(1)
    alphabet = "abcÄßé ,.1\n漢"
    found = ["", None, "a", "1 2", "İstanbul", "".join(chr(0x4E00 + i) for i in range(600))] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(60)]
    for t in found:
        codes, times = langid.grams(langid.characters(t))
        assert dict(zip(codes.tolist(), times.tolist())) == {code(g): n for g, n in slow_grams(t).items()}


def test_distance_equals_brute_force():
    rng = random.Random(2)
    ranked = {x: langid.top_grams(text(x, rng, 400), 50) for x in SYLLABLES}
    profiles = langid.Profiles(ranked, 50)
    for t in [text(x, rng, 9) for x in SYLLABLES] + ["xyz", "ba schung"]:
        own = [g for _, g in sorted((-n, code(g)) for g, n in slow_grams(t).items())[:50]]
        apart = {x: sum(abs(np.flatnonzero(r == g)[0] - i) if g in r else 50 for i, g in enumerate(own)) for x, r in ranked.items()}
        lang, score = profiles.predict(t)
        assert lang == min(apart, key=lambda x: (apart[x], x)) and abs(score - (1 - apart[lang] / (50 * len(own)))) < 1e-12


def slow_profiles(rows, ranks=300):
    """{lang: n-grams by rank} of (doc_id, text, lang) in the training folds."""
    count = {}
    for d, t, lang in rows:
        if lang is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 4 != 2:
            count.setdefault(lang, Counter()).update(slow_grams(t))
    return {x: [g for _, g in sorted((-n, code(g)) for g, n in c.items())[:ranks]] for x, c in count.items() if c}


def slow_predict(profiles, t, ranks=300):
    own = [g for _, g in sorted((-n, code(g)) for g, n in slow_grams(t).items())[:ranks]]
    if not own or not profiles:
        return "und", 0.0
    apart = {x: sum(abs(r.index(g) - i) if g in r else ranks for i, g in enumerate(own)) for x, r in profiles.items()}
    lang = min(apart, key=lambda x: (apart[x], x))
    return lang, 1 - apart[lang] / (ranks * len(own))


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, text(x, rng, rng.randrange(1, 30)), x if i % 9 else None) for i, x in enumerate(rng.choices(list(SYLLABLES), k=80))]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (None, text("cc", rng), "cc"), (905, "ba", "aa"), (905, "ba", "aa"), (906, "ko KO", "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = langid.op8_language_id(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    profiles = slow_profiles(rows)
    want = sorted((d if d is not None else -1, zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2, *slow_predict(profiles, t)) for d, t, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, r.score) for r in found.collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_held_out_accuracy_and_hostile_rows(spark):
    rng = random.Random(3)
    rows = [(i, text(x, rng), x) for i, x in enumerate(rng.choices(list(SYLLABLES), k=300))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (903, text("aa", rng, 30000), None), (None, text("bb", rng), "bb"), (904, "ba", ""), (905, "ba", "aa"), (905, "ba", "aa")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    profiles = langid.fit_profiles(langid.training_rows(docs))
    assert profiles.langs == ["", *sorted(SYLLABLES)]  # an empty name is one that was given
    got = langid.identify(docs, profiles).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows[:300]}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) >= 297
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert langid.identify(docs.limit(0), profiles).collect() == []
    assert langid.identify(docs, langid.fit_profiles(docs.limit(0).select("doc_id", "text", "lang"))).where("lang_pred <> 'und'").count() == 0


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "ba ko", None, 2.5), (None, None, "x", None), (3, "12", "y", 1.0)], "doc_id long, text string, score string, lang_pred double")
    profiles = langid.Profiles({"aa": langid.top_grams("ba ko mi ta")})
    kept = langid.keep_identified(docs, profiles)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [(1, "ba ko", None, 2.5)]


def test_filter_writes_the_language_and_rejects_what_is_like_none(spark):
    rng = random.Random(5)
    rows = [(i, text("aa", rng), "aa") for i in range(40)] + [(50, text("aa", rng), None), (51, text("aa", rng), "bb"), (52, "жщ юэ " * 9, "aa"), (53, "...", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = langid.training_rows(docs.where("doc_id < 50"))
    profiles = langid.fit_profiles(train)
    least = langid.least_likeness(train, profiles)
    assert 0.1 < least < 0.9
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs, profiles, least=least).collect()}
    assert kept == {i: "aa" for i in [*range(40), 50, 51]}
    none = langid.fit_profiles(train.limit(0))
    assert langid.least_likeness(train.limit(0), none) == 0.0
    assert {r.doc_id: r.lang for r in langid.keep_identified(docs, none).collect()} == {d: x for d, t, x in rows if d != 53}
