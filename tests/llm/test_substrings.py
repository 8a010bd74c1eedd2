import hashlib
import random
import re

from cellweave.llm import substrings, words
from cellweave.llm.substrings import FingerprintIndex, dedup_passages


def slow(rows, history=()):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for d, t in [*history, *rows]:
        w = split(t)
        for p in range(len(w) - 12):
            if d is not None:
                x = tuple(w[p : p + 13])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = {q for p in range(len(w) - 12) if d is not None and first[tuple(w[p : p + 13])] < d for q in range(p, p + 13)}
        out.append((-1 if d is None else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(40)] + ["a", "b"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice((13, 14, 30, 80)))] for _ in range(6)]
    rows = []
    for d in rng.sample(range(500), n):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(40))]
        rows.append((d, " \n".join(w)))
    return rows


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_equals_brute_force(spark):
    rows = texts(1) + [(900, None), (901, ""), (None, "x " * 20), (902, "y " * 3000), (903, "y " * 12), (904, "y " * 13), (905, "z " * 40), (905, "z " * 40)]
    docs = spark.createDataFrame([(*r, "c", b"") for r in rows], "doc_id long, text string, starts string, raw binary").repartition(3)
    want = slow(rows)
    assert result(dedup_passages(docs, batches=3)) == want
    assert sum(x[2] for x in want) > 500


def test_hot_anchors_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    rows = texts(2)
    assert result(dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_index_goes_on_and_compacts(spark):
    rows = sorted(texts(3, 80))
    index, done = FingerprintIndex(spark, fanout=2), []
    for i in range(0, 80, 20):
        part = rows[i : i + 20]
        docs = spark.createDataFrame(part, "doc_id long, text string")
        history = spark.createDataFrame(done, "doc_id long, text string") if done else None
        assert result(dedup_passages(docs, batches=1, index=index, history=history)) == slow(part, done)
        done += part
    assert len(index.runs) == 1 and index.runs[0][0] == 2
    index.remove()


def test_an_index_is_opened_again_and_goes_on(spark, tmp_path):
    rows, path = sorted(texts(4, 60)), f"file://{tmp_path}/index"
    table = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first = FingerprintIndex(spark, path=path)
    assert result(dedup_passages(table(rows[:30]), batches=2, index=first)) == slow(rows[:30])
    assert [level for level, _ in first.runs] == [1]
    first.close()
    again = FingerprintIndex.open(spark, path)
    assert (again.version, again.runs, again.buckets, again.window) == (first.version, first.runs, first.buckets, 13)
    assert result(dedup_passages(table(rows[30:]), batches=1, index=again, history=table(rows[:30]))) == slow(rows[30:], rows[:30])
    again.remove()
    assert not (tmp_path / "index").exists()


def test_a_run_that_no_manifest_names_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = FingerprintIndex(spark, path=path)
    index.add(spark.createDataFrame([(1, b"a " * 20)], "doc_id long, raw binary"))
    lost = index._write(spark.createDataFrame([(1, 2)], "anchor long, doc_id long"))  # as by a job that ends here
    assert lost not in [name for _, name in FingerprintIndex.open(spark, path).runs]


def test_the_query_compacts_and_leaves_no_table(spark, monkeypatch, tmp_path):
    rows, merged = texts(5), []
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compact = FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (compact(self), merged.append([k for k, _ in self.runs])))
    before = {t.name for t in spark.catalog.listTables()}
    found = substrings.op7_substring_dedup(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, found.collect())) == [(d, n, r, sha(t)) for d, n, r, t in slow(rows)]
    assert merged == [[0], [1], [1, 0]]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_any_long_is_an_id(spark):
    words = " ".join(f"v{i}" for i in range(20))
    rows = [(-(1 << 63), words), (0, words), ((1 << 63) - 1, words), (5, None)]
    assert result(dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_long_texts_are_hashed_in_pieces():
    rng = random.Random(6)
    raw = b" ".join(rng.choice((b"a", b"bc", b"x" * 900, b"\t \n")) * rng.randrange(1, 3) for _ in range(4000))
    whole = next(words.text_word_hashes([raw], limit=1 << 30))[3][0]
    for limit in (100, 1000, 5000):
        (at, to, first, (hashes,)), = words.text_word_hashes([raw], limit=limit)
        assert (at, to) == (0, 1) and first.tolist() == [0, len(raw.split())] and (hashes == whole).all()
    each = list(words.text_word_hashes([b"", b"a b", b"c"], limit=2))
    assert [x[:2] for x in each] == [(0, 2), (2, 3)] and [len(x[3][0]) for x in each] == [2, 1]


def test_empty_table(spark):
    assert dedup_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
