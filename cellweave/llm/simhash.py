"""SimHash near-duplicate detection: 64-bit fingerprints linked by a binary trie self-join.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link where
they differ in few bits. The join walks pairs of trie nodes together, adds up the bits in which their paths
differ, and drops a pair once the error budget is exceeded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, raw_text, stage
from .components import connected_components

SEED = 42
#: Node pairs that are expanded together; bounds the memory of a join.
CHUNK = 200_000


def fingerprint(raw: bytes, words_in_shingle: int = 3) -> int:
    """The unsigned fingerprint of UTF-8 bytes: A-Z lowered, words split at ASCII white space, shingles joined by a space.

    Fewer words than a shingle: the whole sequence is the one shingle. No word: 0.
    """
    words = raw.lower().split()  # of bytes: lowers A-Z only, and splits at exactly \x20 and \x09-\x0D
    n = len(words) - words_in_shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, words)))
    spans = zip([0, *(e + i for i, e in enumerate(ends[: n - 1], 1))], (e + i for i, e in enumerate(ends[words_in_shingle - 1 :], words_in_shingle - 1)))
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            fps = np.fromiter((fingerprint(raw, words_in_shingle) for raw in part["raw"]), np.uint64, len(part))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    rows = raw_text(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return map_pandas(rows, run, "doc_id long, fp long")


class _Forest:
    """Union-find over positions 0..n-1, by whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.steps = np.zeros(n, np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
        self.steps = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])]) if len(self.root) else self.steps

    def joined(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Whether all of both ranges is one component already."""
        s = self.steps
        return (s[ahi - 1] == s[alo]) & (s[bhi - 1] == s[blo]) & (self.root[alo] == self.root[blo])


def trie_links(keys: np.ndarray, max_bits: int, shared: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what Hamming distances up to max_bits connect, among keys alike in their first `shared` bits.

    keys: unsigned 64-bit, in any order, distinct. The trie is implicit: a node is a range of the sorted keys. Pairs
    of nodes go down together; a pair goes when its differing bits exceed max_bits, or when both nodes lie in one
    component already, so that a dense cloud of keys costs a forest of links and not all its pairs. Returns a star
    for each component. Memory: some 40 bytes a key, and CHUNK pairs of nodes a level.
    """
    keys = np.sort(keys)
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return keys[:0], keys[:0]
    forest.steps = np.arange(n)

    def middle(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the next bit turns to 1 in nodes whose keys are alike in the first `depth` bits."""
        rest = np.uint64(63 - depth)
        return np.clip(np.searchsorted(keys, ((keys[lo] >> rest) | np.uint64(1)) << rest), lo, hi)

    if shared:
        top = keys >> np.uint64(64 - shared)
        lo = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        hi = np.append(lo[1:], n)
    else:
        lo, hi = np.array([0]), np.array([n])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(shared, lo[i : i + CHUNK], hi[i : i + CHUNK], lo[i : i + CHUNK], hi[i : i + CHUNK], np.zeros(len(lo[i : i + CHUNK]), np.int64)) for i in range(0, len(lo), CHUNK)]
    while stack:
        depth, alo, ahi, blo, bhi, bits = stack.pop()
        go = ~forest.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, bits = (x[go] for x in (alo, ahi, blo, bhi, bits))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (np.bitwise_count(keys[a] ^ keys[b]) <= max_bits) & (a != b)
            if near.any():
                forest.link(a[near], b[near])
            alo, ahi, blo, bhi, bits = (x[~leaf] for x in (alo, ahi, blo, bhi, bits))
        if not len(alo):
            continue
        if len(alo) > CHUNK:
            half = len(alo) // 2
            stack += [(depth, *(x[s] for x in (alo, ahi, blo, bhi, bits))) for s in (slice(half, None), slice(half))]
            continue
        amid, bmid = middle(alo, ahi, depth), middle(blo, bhi, depth)
        same = alo == blo
        cross = ~same
        two = np.concatenate
        pairs = (
            two([alo, amid, alo, amid[cross]]), two([amid, ahi, amid, ahi[cross]]),
            two([blo, bmid, bmid, blo[cross]]), two([bmid, bhi, bhi, bmid[cross]]),
            two([bits, bits, bits + 1, bits[cross] + 1]),
        )
        ok = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= max_bits)
        ok &= (pairs[0] != pairs[2]) | (pairs[1] - pairs[0] > 1)
        if ok.any():
            stack.append((depth + 1, *(x[ok] for x in pairs)))
    away = forest.root != np.arange(n)
    return keys[away], keys[forest.root[away]]


def near_links(fps: DataFrame, max_bits: int = 3, fp_col: str = "fp", parts: int | None = None) -> DataFrame:
    """(src, dst) links that connect the same distinct fingerprints as all pairs within max_bits do.

    64 bits fall into max_bits + 1 blocks; fingerprints within the budget agree on one block at least. Each
    fingerprint goes once for each block to the task that holds all fingerprints with that block's value, and there
    into the trie join. So the shuffle is max_bits + 1 rows a fingerprint, and no pair is lost.
    """
    blocks = max_bits + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    turned = [F.shiftleft(fp_col, edges[t]).bitwiseOR(F.shiftrightunsigned(fp_col, 64 - edges[t])) if t else F.col(fp_col) for t in range(blocks)]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), turned[t].alias("key"), F.shiftrightunsigned(turned[t], 64 - (edges[t + 1] - edges[t])).alias("block")) for t in range(blocks)))
    rows = fps.where(F.col(fp_col).isNotNull()).select(fp_col).distinct().select(F.explode(tables).alias("x")).select("x.*")
    rows = rows.repartition(parts, "t", "block") if parts else rows.repartition("t", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(p["t"].to_numpy(), p["key"].to_numpy().view(np.uint64)) for p in batches]
        if not held:
            return
        t, keys = (np.concatenate(x) for x in zip(*held))
        for k in range(blocks):
            src, dst = trie_links(keys[t == k], max_bits, edges[k + 1] - edges[k])
            if edges[k] and len(src):
                back, rest = np.uint64(edges[k]), np.uint64(64 - edges[k])
                src, dst = (src >> back) | (src << rest), (dst >> back) | (dst << rest)
            for i in range(0, len(src), CHUNK):
                yield pd.DataFrame({"src": src[i : i + CHUNK].view(np.int64), "dst": dst[i : i + CHUNK].view(np.int64)})

    return map_pandas(rows, run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id: the smallest id reachable over links of max_bits or fewer differing bits, the row's own included.
    Copies share a fingerprint, so a group of copies is one node of the join, however large. Null or empty text:
    fingerprint 0, linked as any other. Null id: the row stays, and its id is no candidate for component_id (null
    if its component has no other). Repeated rows: each is returned. Other columns are ignored. Empty table: no rows.
    """
    own = stage(fingerprints(docs, id_col, text_col, words_in_shingle), "simhash")
    nodes = stage(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comps = connected_components(near_links(nodes, max_bits))
    named = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = stage(named.join(lowest, "comp").select("fp", "component_id"), "simhash-classes")
    return own.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def later_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """(doc_id): distinct ids of the rows that have a near duplicate with a smaller id."""
    found = near_duplicates(docs, id_col, text_col, max_bits)
    return found.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """docs without the rows that have a near duplicate with a smaller id; columns as they were.

    Rows with a null id stay. Of rows that share one id, all stay or go together.
    """
    gone = later_ids(docs, id_col, text_col, max_bits).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
