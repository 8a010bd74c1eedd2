import math
import random
import re

from cellweave.llm import quality


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, x in enumerate(w) if w.count(x) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", "  ", "a", "a b", "a a a", "a a a a", "é\x0bß x y#\ny#\n\n \n", "line | x\nline | x\n q"]
    texts += [" ".join(rng.choice("abcd\n") for _ in range(rng.randrange(60))) for _ in range(60)]
    for t in texts:
        assert quality.measure(t)[:5] == slow(t), t
    assert quality.measure("x y " * 20000)[4] == 40000


def test_binomial_tail_is_exact():
    for n, p in ((5, 0.3), (40, 0.02)):
        for k in range(n + 1):
            assert abs(quality.binomial_tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    n = quality.least_holdouts(0.02, 0.01)
    assert quality.binomial_tail(0, n, 0.02) <= 0.01 < quality.binomial_tail(0, n - 1, 0.02)


def test_cutoffs_hold_their_risk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        bad = i % 5 == 0
        rows.append((i, "en" if i % 2 else None, int(not bad), rng.uniform(0.3, 0.9) if bad else rng.uniform(0, 0.12) if rng.random() < 0.999 else 0.5))
    rows += [(9000 + i, "xx", 1, 0.0) for i in range(20)]
    measured = spark.createDataFrame([(i, s or "", x) for i, s, _, x in rows], "doc_id long, stratum string, symbol_rate double")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, label int")
    found = quality.certified_cutoffs(measured, labels, 0.02, 0.05, {"symbol_rate": quality.GRID})
    assert sorted(found["stratum"]) == ["", "en"]
    assert (found["p_value"] <= 0.05 / 2).all() and (found["rejected_good"] <= 0.02 * found["good"]).all() and (found["rejected_bad"] > 100).all()


def test_verdicts_and_hostile_rows(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i} |" for i in range(60))
    rows = [(i, (bad if i % 5 == 0 else good) + f" x{i}", "en") for i in range(3000)] + [(None, good, "en"), (4001, None, "en"), (4002, "", None), (4003, "a b c " * 4000, "en"), (4004, bad, "zz"), (4005, good, "en"), (4005, good, "en")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(3000)] + [(None, 1), (5, None), (7, 1), (7, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, labels).collect()}
    assert got[1].kept and not got[10].kept and got[10].rejected_by and not got[10].base_failed
    assert got[None].kept and got[4001].base_failed and got[4002].base_failed and got[4003].base_failed and got[4004].kept and got[4005].kept
    assert quality.quality_verdicts(docs.limit(0), labels).collect() == []
    assert quality.quality_verdicts(docs, labels.limit(0)).where("kept").count() == 3004
