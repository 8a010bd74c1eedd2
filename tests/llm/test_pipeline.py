import hashlib
import random
from itertools import combinations

from cellweave.llm import mixing, sentencepieces
from tests.llm.test_langid import slow_predict, slow_profiles
from tests.llm.test_linededup import slow as slow_lines
from tests.llm.test_mixing import slow_bounded_rake
from tests.llm.test_overlap import slow_set
from tests.llm.test_simhash import slow_components

import corpus_pipeline


def corpus():
    rng = random.Random(11)
    vocab = {x: [x[0] + "".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)] for x, letters in (("en", "abcdefgh"), ("fr", "éçuoiè"))}
    notice = "\n".join("shared " + "".join(rng.choices("abc", k=9)) for _ in range(4))
    rows = []
    for i in range(0, 240, 2):
        lang = rng.choice(("en", "en", "fr"))
        lines = ["".join(rng.choice(vocab[lang]) + " " for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            lines.insert(0, notice)
        rows.append((i, "\n".join(lines), lang, rng.choice(("s0", "s0", "s1"))))
    rows += [(1001 + i, rows[i][1] if i % 2 else rows[i][1].replace(" ", "  ", 1), rows[i][2], "s2") for i in range(0, 60, 3)]
    return rows + [(2001, None, "en", "s0"), (2002, "", "en", "s0"), (2003, "12 34", None, "s1")]


def slow_run(rows, codec):
    profiles = slow_profiles([r[:3] for r in rows])
    told = {d: slow_predict(profiles, t) for d, t, *_ in rows}
    rows = [(d, t, told[d][0], source) for d, t, _, source in rows if told[d][0] != "und"]  # none is below half of the least likeness
    texts = {d: t for d, _, _, t in slow_lines([r[:2] for r in rows])}
    first = {d: c for d, _, c in slow_components(list(texts.items()))}
    sets = {d: slow_set(t) for d, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        if first[a] != first[b] and len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])):
            low, high = sorted((first[a], first[b]))
            first = {d: low if c == high else c for d, c in first.items()}
    rows = [(d, texts[d], lang, source) for d, _, lang, source in rows if first[d] == d]
    cells, of = {}, {}
    for d, t, lang, source in rows:
        topic = "notice" if "icense" in t else "prose"
        of[d] = (source, lang or "", topic)
        if n := len(t.split()):
            cells[of[d]] = cells.get(of[d], 0) + n
    targets = []
    for m in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[m]] = sums.get(c[m], 0) + t
        targets.append({k: t**0.7 / sum(x**0.7 for x in sums.values()) for k, t in sums.items()})
    factor = slow_bounded_rake(cells, targets, mixing.ROUNDS, 0.5)
    out = {}
    for d, t, *_ in rows:
        p = factor[of[d]] if t.split() else 0
        if int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / 2**52 < p:
            ids, _ = codec.encode([t.encode()])
            out[d] = ids.tolist()
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = slow_run(rows, sentencepieces.Codec())
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) > 20 and all(r.exact for r in got)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 1, 2, 3, 4, 5), (None, None, None, None, None, 1, 2, 3, 4, 5)], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_removed int, gone int, _own int, _kept int")
    for name, step in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            out = step(spark, own, "")
            assert out.columns == docs.columns, name
            out.collect()
