import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cellweave.llm import cws


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_equals_brute_force(spark, monkeypatch):
    plain = cws.id_ranges
    monkeypatch.setattr(cws, "id_ranges", lambda d, c: plain(d, c, 20))
    rng = random.Random(1)
    vocab = [f"w{i}é" for i in range(120)]
    rows = [(d * 5, " ".join(rng.choices(vocab, k=rng.randrange(1, 120)))) for d in rng.sample(range(4000), 300)]
    rows += [(30001, None), (30002, ""), (None, "a b\n c"), (30003, "x " * 20000), (30004, rows[0][1]), (30005, "q"), (30005, "p")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, range int").repartition(3)
    got = cws.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        want[d, len(t)] = (t, t[: len(t) - m] + after[:m], after)
    by_text, errors = {}, []
    for r in got:
        t, edited, after = want[r.doc_id, r.n_chars]
        if r.doc_id != 30005:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            errors += [abs(r.near_edited - jaccard(t, edited)), abs(r.near_next - jaccard(t, after))]
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.3
    assert len(set(by_text.values())) == len(by_text) - 0
    assert by_text[rows[0][1]] and by_text[""]


def test_ranges_do_not_change_results(spark, monkeypatch):
    docs = spark.createDataFrame([(i * 3, f"a{i % 7} b{i % 5} c d{i}") for i in range(200)], "doc_id long, text string")
    whole = sorted(map(tuple, cws.fingerprints(docs).drop("samples").collect()))
    plain = cws.id_ranges
    monkeypatch.setattr(cws, "id_ranges", lambda d, c: plain(d, c, 7))
    assert sorted(map(tuple, cws.fingerprints(docs.repartition(5)).drop("samples").collect())) == whole


def test_small_tables(spark):
    one = cws.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert cws.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = cws.fingerprints(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert len(none) == 2


def test_ranges_follow_the_rows(spark):
    ids = [*range(20_000), 1 << 62, (1 << 63) - 1, -(1 << 63)]
    docs = spark.createDataFrame([(i,) for i in [*ids, None, None]], "doc_id long")
    number, heads = cws.id_ranges(docs, "doc_id")
    of = docs.select("doc_id", number.alias("r")).collect()
    held = {}
    for r in of:
        held.setdefault(r.r, []).append(r.doc_id)
    assert len(held) > 10 and max(map(len, held.values())) < 4_000 and held[0].count(None) == 2
    tops = [max(i for i in held[r] if i is not None) for r in sorted(held)]
    assert tops == sorted(tops)
    assert {(h.head, h.into) for h in heads.collect()} >= {(tops[i], i + 1) for i in range(len(tops) - 1)} | {(tops[-1], 0)}


def test_ids_with_many_rows_are_split(spark, monkeypatch):
    """A third of the rows without an id, a third of one id, the greatest or one amid the others: no range is large, and every row has the next
    text of the whole order."""
    plain, rng = cws.id_ranges, random.Random(3)
    monkeypatch.setattr(cws, "id_ranges", lambda d, c: plain(d, c, 20))
    monkeypatch.setattr(cws, "_MARKS_IN_RANGE", 4)
    for hot in (700, 9_000):
        rows = [(d, f"own {d} {'z' * (d % 9)}") for d in range(400, 800)] + [(d, f"many {d} {i} {'y' * rng.randrange(30)}") for i in range(400) for d in (None, hot)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        number, heads = cws.id_ranges(docs, "doc_id")
        sizes = Counter(r.r for r in docs.select(number.alias("r")).collect())
        assert len(sizes) > 20 and max(sizes.values()) < 150 and {h.head for h in heads.where("part is not null").collect()} == {None, hot}
        hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]] if r[0] in (None, hot) else 0, r[1]))
        want = []
        for i, (d, t) in enumerate(order):
            m = len(t) // 3
            want.append((str(d), hashlib.sha256((t[: len(t) - m] + order[(i + 1) % len(order)][1][:m]).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.edited_sha256) for r in cws.fingerprints(docs).select("doc_id", "edited_sha256").collect()) == sorted(want)


def test_copies_of_one_row_and_no_ids_at_all(spark, monkeypatch):
    plain = cws.id_ranges
    monkeypatch.setattr(cws, "id_ranges", lambda d, c: plain(d, c, 10))
    same = cws.fingerprints(spark.createDataFrame([(None, "a b c")] * 60 + [(5, "a b c")] * 60, "doc_id long, text string").repartition(3)).collect()
    assert len(same) == 120 and {(r.near_next, r.edited_sha256) for r in same} == {(1.0, hashlib.sha256(b"a b a").hexdigest())}
    none = cws.fingerprints(spark.createDataFrame([(None, f"t{i} u{i}") for i in range(300)], "doc_id long, text string").repartition(3)).collect()
    assert len(none) == 300 and len({r.fingerprint for r in none}) == 300


def test_any_long_is_an_id(spark):
    rows = [(-(1 << 63), "a b c d e f"), ((1 << 63) - 1, "g h i"), (0, "k l m n o"), (None, "p q r s")]
    got = {r.doc_id: r.edited_sha256 for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [rows[1], rows[2], rows[0], rows[3]]
    for i, (d, t) in enumerate(order):
        m = len(t) // 3
        assert got[d] == hashlib.sha256((t[: len(t) - m] + order[(i + 1) % 4][1][:m]).encode()).hexdigest()


def test_likeness_is_unbiased_over_a_large_vocabulary(spark):
    """Places of two texts agree as often as the generalised Jaccard similarity says: 250 pairs from 30,000 words, whose
    terms share rows of the tables of draws."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(250):
        a = rng.choices(range(30_000), k=200) * 2
        b = [w if rng.random() < i / 250 else rng.randrange(30_000) for w in a]
        rows += [(2 * i + 1, " ".join(f"v{w}" for w in a)), (2 * i, " ".join(f"v{w}" for w in b))]
        want[2 * i + 1] = jaccard(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = [got[d].near_next - j for d, j in want.items()]
    assert abs(sum(errors) / len(errors)) < 0.012 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.07


def test_the_query(spark, tmp_path):
    rows = [(i, f"a b c{i % 3} d e f") for i in range(9)] + [(20, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = cws.op10_fingerprints(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 10 and got[0].fingerprint == got[3].fingerprint != got[1].fingerprint
    for d, r in got.items():
        own, edited = (cut(x) for x in (r.fingerprint, r.edited_fingerprint))
        after = cut(got[{0: 20, 20: 8}.get(d, d - 1)].fingerprint)
        assert r.near_edited == sum(x == y for x, y in zip(own, edited)) / cws.PLACES
        assert r.near_next == sum(x == y for x, y in zip(own, after)) / cws.PLACES


def cut(fingerprint):
    return [fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").select(F.col("doc_id"), F.col("text"))
    plan = cws.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
