import random

import corpus_pipeline
from pyspark.sql import functions as F

from cellweave.llm import common, overlap
from cellweave.llm.common import stage


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows, least=0.8):
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(d for k, (d, _) in enumerate(rows) if label[k] == x) for x in set(label)}


def make():
    rng = random.Random(4)
    rows = []
    for size, changes in ((100, 1), (100, 2), (100, 3), (100, 6), (400, 8), (1000, 15), (7, 1), (4, 0)):
        for _ in range(6):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            rows.append((len(rows) * 37 % 499, " ".join(base)))
            for k in rng.sample(range(size), changes):
                base[k] = f"z{rng.randrange(3000)}"
            rows.append((len(rows) * 37 % 499, "  ".join(base).upper()))
    return rows


def test_stage_equals_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (600, "x"), (601, "x y")], "doc_id long, text string").repartition(3)
    want = slow_kept(rows)
    assert 40 < len(want) < 70
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want | {None, 600, 601}


def test_similarity_and_large_buckets(spark):
    rng = random.Random(7)
    a, b = ("a b c d e f g h i j", "a b c d e f g h i k")
    assert overlap.jaccard(overlap.shingle_hashes(a.encode()), overlap.shingle_hashes(b.encode())) == 5 / 7
    assert overlap.bands(overlap.shingle_hashes(b" ")) == [] and len(overlap.shingle_hashes(b"one two")) == 1
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        own[rng.randrange(300)] = f"z{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in overlap.later_ids(docs).collect()) == list(range(1, 150))
    two = docs.where("doc_id in (1, 2)")
    classes = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "doc_id long, component_id long")
    assert sorted(r.doc_id for r in overlap.later_ids(two, classes=classes).collect()) == [1, 2]


def test_texts_that_share_bands_without_being_alike_are_all_compared(spark, monkeypatch):
    """Buckets whose members fall into many groups, some of which only members that lead none connect."""
    monkeypatch.setattr(overlap, "bands", lambda hashes: [1, 2] if len(hashes) else [])
    monkeypatch.setattr(overlap, "BLOCK", 20)
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(6):  # a chain: each like its neighbours only
            rows.append((len(rows) * 29 % 997, " ".join(base)))
            for at in rng.sample(range(60), 1):
                base[at] = f"z{len(rows)}"
    docs = spark.createDataFrame([*rows, (998, rows[0][1])], "doc_id long, text string").repartition(3)
    kept = slow_kept(rows)
    assert 12 <= len(kept) < 30
    assert {r.doc_id for r in overlap.later_ids(docs).collect()} == {d for d, _ in rows} - kept | {998}


def _shuffled(spark, stages_before=None):
    """Bytes written to shuffles by the stages that are not in stages_before, and the ids of all stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    own = [every.apply(i) for i in range(every.size())]
    return sum(x.shuffleWriteBytes() for x in own if stages_before is None or x.stageId() not in stages_before), {x.stageId() for x in own}


def test_texts_that_nothing_resembles_are_not_shuffled(spark):
    """Neither to find candidates' shingles nor to drop what is a near copy, where the ids are too many to be broadcast."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i in range(400)]
    rows += [(1000 + i, text + " more") for i, text in rows[:8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = stage(docs, "texts")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, -1)
    try:
        _, seen = _shuffled(spark)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
        moved, _ = _shuffled(spark, seen)
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert sorted(map(tuple, kept)) == rows[:400]
    assert moved < sum(len(t) for _, t in rows) / 2


def test_no_id_is_told_apart_from_itself(spark, monkeypatch):
    monkeypatch.setattr(common, "CELLS", 1 << 16)
    rows = spark.range(-3000, 9000).select("id", F.lit("x").alias("bitmap.bits")).union(spark.createDataFrame([(None, "n")], "id long, x string"))
    ids = spark.range(-3000, 9000, 3).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    got = common.maybe_among(rows, "id", ids, "maybe")
    assert got.columns == [*rows.columns, "maybe"] and got.count() == 12_001
    told = {r.id for r in got.where("not maybe").collect()}
    assert not told & set(range(-3000, 9000, 3)) and len(told) > 7000
    assert common.maybe_among(rows, "id", ids.limit(0), "maybe").where("maybe").isEmpty()
