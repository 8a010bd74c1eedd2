"""Shards against a plain loop over the whole order, and what must hold of any sharding."""

import hashlib
import random
import zlib
from bisect import bisect_right

from cellweave.llm import sharding


def slow(rows, n=8, tolerance=sharding.TOLERANCE, group=sharding.GROUP):
    """{(doc_id, text): {(shard, slot)}} from the definition: boundaries of all cells of every round, and the nearest of each."""
    own = []
    for d, t in rows:
        raw = (t or "").encode()
        key = int(hashlib.md5(raw).hexdigest()[:15], 16)
        tie = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:14], 16)
        own.append((key, tie, d is not None, d or 0, len(raw) + 1, d, t))
    own.sort(key=lambda x: x[:4])
    total = sum(x[4] for x in own)
    by_key = {}
    for x in own:
        by_key[x[0]] = by_key.get(x[0], 0) + x[4]
    rounds = [(b, 0) for b in (12, 20, 28, 36, 44, 52, 60)] + [(60, b) for b in range(8, 57, 8)]
    ends = []
    for k in range(1, n):
        best = None
        for kb, tb in rounds:
            bounds, at, before = [], 0, None
            for x in own:
                cell = (x[0] >> (60 - kb), (x[1] >> (56 - tb)) if tb and n * by_key[x[0]] > group * total else 0)
                if cell != before:
                    bounds.append(at)
                at, before = at + x[4], cell
            place = min([*bounds, total], key=lambda b: (abs(n * b - k * total), b))
            best = place
            if abs(n * place - k * total) <= tolerance * total:
                break
        ends.append(best)
    out, at, slots, first = {}, 0, [0] * n, {}
    for x in own:
        # rows of one key and tie go by where the first of them is
        s = bisect_right(ends, first.setdefault(x[:2], at))
        out.setdefault((x[5], x[6]), set()).add((s, slots[s]))
        slots[s] += 1
        at += x[4]
    return out


def sharded(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r.doc_id, r.text), set()).add((r.shard, r.slot))
    return out


def docs_of(rng, n):
    return [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 10, 40, 200))))) for i in range(n)]


def test_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = docs_of(rng, 700)
    # a third of all rows of one text, groups of copies, nulls, empty and long texts, repeated rows
    rows += [(10_000 + i, "the same text again and again") for i in range(400)] + [(20_000 + i, rows[i // 9][1]) for i in range(90)]
    rows += [(None, None), (None, "x"), (30_000, None), (30_001, ""), (30_002, "long " * 3000), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (64, 1 << 20):
        got = sharding.shard(docs, part_bytes=size)
        assert sharded(got) == slow(rows)
    sizes = {}
    for r in got.collect():
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    assert sorted(sizes) == list(range(8)) and all(sorted(s for s, _ in x) == list(range(len(x))) for x in sizes.values())


def test_balance_and_groups(spark):
    rng = random.Random(9)
    rows = docs_of(rng, 6000) + [(10_000 + i, "one text of a hot group " * 4) for i in range(3000)] + [(20_000 + i, f"group {i // 3} " * 5) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, shards = [0] * 8, {}
    for r in got:
        sizes[r.shard] += r.size
        shards.setdefault(r.text, set()).add(r.shard)
    ideal = sum(sizes) / 8
    assert max(abs(x - ideal) for x in sizes) < 0.01 * ideal
    parted = [t for t, x in shards.items() if len(x) > 1]
    assert parted in ([], [rows[6000][1]]) and len(shards[rows[6000][1]]) > 1


def test_one_exchange(spark, capsys):
    docs = spark.createDataFrame(docs_of(random.Random(1), 50), "doc_id long, text string")
    sharding.shard(docs).explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def test_columns_and_emptiness(spark, tmp_path):
    rows = [(1, "a", 7, "s"), (2, "b", 8, "t"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "`my id` long, body string, shard int, `part` string")
    got = sharding.shard(docs, n=2, id_col="my id", text_col="body")
    assert got.columns == ["my id", "body", "shard", "part", "shard_", "slot", "size", "text_crc32"]
    assert sorted((r[0], r.shard, r.part) for r in got.collect()) == [(1, 7, "s"), (2, 8, "t"), (3, None, None)]
    none = sharding.shard(docs.limit(0), id_col="my id", text_col="body")
    assert none.collect() == [] and none.columns == got.columns
    back = sharding.write_shards(spark.createDataFrame(docs_of(random.Random(2), 40), "doc_id long, text string"), f"{tmp_path}/out", n=4)
    assert back.count() == 40 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "ä b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op12_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got.collect()} == {(1, 5, zlib.crc32("ä b".encode()), "bytes", None), (2, 1, 0, "bytes", None)}
