import random

from cellweave.llm.linededup import dedup_lines, line_report, op6_line_dedup


def slow(rows):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\r\x0b\x0c") for x in w):
                first.setdefault(w, (d, p))
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if d is not None and w in first and first[w] != (d, p):
                gone |= {p, p + 1, p + 2}
        out.append((d, len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for d in rng.sample(range(1000), 60)]
    rows += [(2000, None), (2001, ""), (None, "a\nb\nc"), (2002, "\n\n\n\n \n"), (2003, "z\n" * 4000), (2004, "q\nr\ns\nt"), (2005, "x\nq\nr\ns\ny\r\n"), (2005, "x\nq\nr\ns\ny\r\n")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, pos string, n_lines int").repartition(4)
    want = slow(rows)
    assert sorted(map(tuple, line_report(docs).collect()), key=str) == want
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, t, "x", 5) for d, _, _, t in want), key=str)


def test_columns_of_any_name_stay(spark):
    names = ["_id", "own", "starts", "OWN_", "_starts", "_lines", "lines", "kept", "_kept", "kept_text", "pos", "h1", "first", "n", "n_lines", "n_removed", "a.b", "text "]
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(i, text, 8, *range(i, i + len(names))) for i in (1, 2)], ["doc_id", "text", "n_chars", *names])
    for n_chars, want in ((None, 8), ("n_chars", 0)):
        got = dedup_lines(docs, n_chars_col=n_chars)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [(1, text, 8, *range(1, 1 + len(names))), (2, "", want, *range(2, 2 + len(names)))]


def test_the_query(spark, tmp_path):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op6_line_dedup(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_lines", "n_removed", "text"]
    assert sorted(map(tuple, found.collect())) == slow(rows)


def test_later_occurrences_go_and_overlaps_merge(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nq")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: "a\nb\nc\nd", 2: "x\ny", 3: "a\nb\nq"}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
