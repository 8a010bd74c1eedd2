import random
import re

import numpy as np
import xxhash

from cellweave.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -1, f"{fps[i]:016x}", min((x for x in low[find(i)] if x is not None), default=-1)) for i, (d, _) in enumerate(rows))


def test_fingerprint_is_the_majority():
    for text in ("", " \t\n", "One", "a b", "A b\x0bC d", "Ä Öl x  y z w", "a " * 5000):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_trie_links_equal_brute_force():
    rng = random.Random(5)
    for n, wide in ((2, 3), (60, 6), (400, 9), (300, 64)):
        base = rng.getrandbits(64)
        keys = {base ^ sum(1 << rng.randrange(wide) for _ in range(rng.randrange(5))) & (2**64 - 1) for _ in range(n)} | {rng.getrandbits(64) for _ in range(40)}
        keys = sorted(keys)
        src, dst = simhash.trie_links(np.array(keys, np.uint64), 3)
        label = {k: k for k in keys}

        def find(k):
            while label[k] != k:
                k = label[k]
            return k

        for i, a in enumerate(keys):
            for b in keys[:i]:
                if bin(a ^ b).count("1") <= 3:
                    label[find(a)] = find(b)
        got = {k: k for k in keys}
        got.update(zip(map(int, src), map(int, dst)))
        assert all((find(a) == find(b)) == (got[a] == got[b]) for a in keys for b in keys)


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((1, 2, 5, 60, 200)))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 7 % 101, " ".join(own)))
    rows += [(200, None), (150, ""), (None, "  "), (201, "ONE TWO"), (202, "one two"), (202, "one two"), (203, "x " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, f"{r.fp & (2**64 - 1):016x}", -1 if r.component_id is None else r.component_id) for r in got) == slow_components(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {c for _, _, c in slow_components(rows)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
