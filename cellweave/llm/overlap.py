"""Near duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, their sets decide.

A text's shingles are runs of consecutive words, as hashes. A band is a few of its minimal hashes under fixed
permutations; texts that share a band are candidates, and a candidate pair is linked if the shingles themselves
are as similar as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_pandas, maybe_among, named, raw_text, release, stage
from .components import connected_components

#: Two texts of similarity 0.8 share none of the bands with a probability of (1 - 0.8**ROWS)**BANDS = 0.0004.
BANDS, ROWS = 20, 5
_draws = np.random.default_rng(42)
_TIMES, _PLUS = (_draws.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) for _ in range(2))
_TIMES |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: every bit depends on all."""
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(times)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(raw: bytes, words_in_shingle: int = 5) -> np.ndarray:
    """Distinct hashes of UTF-8 bytes' shingles, sorted; words as in simhash.fingerprint(), so are fewer words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(words_in_shingle, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mixed(out + own[i : i + n])
    return np.unique(out)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed number a band; none where there is no shingle."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(low, _mixed(hashes[at : at + (1 << 12)] * _TIMES + _PLUS).min(axis=1), out=low)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(row.tobytes()) for row in low.reshape(BANDS, ROWS)], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose sets (doc_id, shingles) are similar, written. Equal ids may have several sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            near = [jaccard(*(np.frombuffer(x, np.uint32) for x in pair)) >= least for pair in zip(part["a"], part["b"])]
            yield part.loc[near, ["src", "dst"]]

    met = pairs.join(sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("b")), "dst")
    return stage(map_pandas(met.select("src", "dst", "a", "b"), check, "src long, dst long").distinct(), "similar-links")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5, least: float = 0.8, classes: DataFrame | None = None) -> DataFrame:
    """(node, comp): what all pairs of texts that share a band and have a similarity of `least` or more connect.

    Nodes are ids, or with classes (doc_id, component_id), ids that are linked already, component ids; those that
    nothing connects are left out. Null ids and texts without a word have no link.

    Texts with the same shingles are linked to one of them, which stands for all. In a band's bucket whose members
    are not all connected yet, a leader, of the smallest group there, is held against the members of other groups,
    and then four more. What is apart in its bucket even so goes into blocks, and each pair of blocks into a task,
    which compares all texts of other groups there and gives out links alone. So a bucket of near copies, however
    large, costs about as many pairs as it has members, no pair is left out, and only texts that share a band without
    being alike cost more: those the square of their number, BLOCK at a time.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [shingle_hashes(raw, words_in_shingle) for raw in part["raw"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "same": [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None for x in found], "size": [len(x) for x in found], "bands": [bands(x) for x in found]}).astype({"same": "Int64"})

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "shingles": [np.unique(shingle_hashes(raw, words_in_shingle).astype(np.uint32)).tobytes() for raw in part["raw"]]})

    rows = raw_text(docs.where(named(id_col).isNotNull()), text_col, named(id_col).cast("long").alias("doc_id"))
    each = map_pandas(rows, sketch, "doc_id long, same long, size int, bands array<long>").where("same is not null")
    if classes is None:
        each = each.withColumn("node", F.col("doc_id"))
    else:
        each = each.join(classes.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("node")), "doc_id")
    each = stage(each, "sketches")
    # of texts with the same shingles one goes on; an id of several texts goes on with each
    alike = stage(each.groupBy("same").agg(F.min(F.struct("doc_id", "node")).alias("x"), F.min("size").alias("size"), F.min_by("bands", "doc_id").alias("bands")).select("same", "x.doc_id", "x.node", "size", "bands"), "alike")
    same = each.select("same", F.col("node").alias("src")).join(alike.select("same", F.col("node").alias("dst")), "same")
    links = stage(same.where("src <> dst").select("src", "dst").distinct(), "same-links")
    key = ["band", "bucket"]
    every = alike.select("doc_id", "node", "size", F.posexplode("bands").alias("band", "bucket"))
    met = every.groupBy(*key).agg((F.min("doc_id") != F.max("doc_id")).alias("many")).where("many").select(*key)
    open_ = stage(every.join(met, key, "left_semi").distinct(), "bucket-members")
    # sets of candidates only: all sets are larger than the texts' files; and only texts that may be candidates' are shuffled
    wanted = stage(open_.select("doc_id").distinct(), "candidates")
    some = maybe_among(rows, "doc_id", wanted, "maybe").where("maybe").select("doc_id", "raw")
    sets = stage(map_pandas(some.join(wanted, "doc_id", "left_semi"), shingles, "doc_id long, shingles binary"), "similar-sets")
    release(docs.sparkSession)
    for n_leaders in (1, 4, None):
        comps = stage(connected_components(links), "similar-groups")
        now = open_.join(comps, "node", "left").select(*key, "doc_id", "node", "size", F.coalesce("comp", "node").alias("comp"))
        groups = now.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
        apart = groups.groupBy(*key).agg(F.sum("n").alias("members"), (F.min("comp") != F.max("comp")).alias("apart")).where("apart").select(*key, "members")
        # a bucket whose members left are one group is done
        now = stage(now.join(groups.join(apart, key), [*key, "comp"]), "groups-apart")
        if now.isEmpty():
            return comps
        if n_leaders is None:
            more = _block_links(now, sets, key, least)
        else:
            order = Window.partitionBy(*key).orderBy("n", "doc_id")
            leaders = stage(now.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n_leaders).select(*key, F.col("doc_id").alias("dst"), F.col("node").alias("dst_node"), F.col("comp").alias("their"), F.col("size").alias("their_size")), "leaders")
            # sets whose sizes differ too much can't be alike
            near = (F.col("size") >= least * F.col("their_size")) & (F.col("their_size") >= least * F.col("size"))
            pairs = now.join(leaders, key).where((F.col("comp") != F.col("their")) & near).select(F.struct("doc_id", "node").alias("a"), F.struct(F.col("dst").alias("doc_id"), F.col("dst_node").alias("node")).alias("b"))
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            pairs = stage(pairs.select(F.col("a.doc_id").alias("src"), F.col("b.doc_id").alias("dst"), F.col("a.node").alias("src_node"), F.col("b.node").alias("dst_node")), "pairs")
            found = _checked(pairs.select("src", "dst").distinct(), sets, least)
            more = pairs.join(found, ["src", "dst"], "left_semi").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
            led = leaders.select(*key, F.col("dst").alias("doc_id"))
            open_ = stage(now.join(led, [*key, "doc_id"], "left_anti").select(*key, "doc_id", "node", "size"), "bucket-members")
        # components of what is known and of what is new are those of all links
        links = stage(comps.where("node <> comp").select(F.col("node").alias("src"), F.col("comp").alias("dst")).union(more).distinct(), "links-so-far")
    return connected_components(links)


#: Members of a bucket that are held in memory against each other, or against as many others.
BLOCK = 1024


def _block_links(rows: DataFrame, sets: DataFrame, key: list[str], least: float) -> DataFrame:
    """(src, dst) nodes of similar texts of different groups. rows: (key, doc_id, node, size, comp, members), where
    members is how many the bucket has.

    A bucket of so many blocks sends each text to as many tasks, one for each block that it meets.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    each = rows.select(*key, "doc_id", "node", "size", "comp", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    each = each.select(*key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "node", "size", "comp").join(sets, "doc_id")
    together = [*key, "low", "high"]

    def links_of(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "node"])
        comp, size, block, node = (own[c].to_numpy() for c in ("comp", "size", "block", "node"))
        held, across, out = [np.frombuffer(x, np.uint32) for x in own["shingles"]], own["low"].iloc[0] != own["high"].iloc[0], []
        for i in range(len(own)):
            near = (comp[i + 1 :] != comp[i]) & (size[i + 1 :] >= least * size[i]) & (least * size[i + 1 :] <= size[i])
            if across:
                near &= block[i + 1 :] != block[i]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if comp[j] != comp[i] and jaccard(held[i], held[j]) >= least:
                    out.append((node[i], node[j]))
                    comp = np.where(comp == comp[j], comp[i], comp)
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in batches:
            names = part[together].apply(tuple, axis=1)
            for name, own in part.groupby(names, sort=False):
                if held and tuple(held[0][together].iloc[0]) != name:
                    yield links_of(pd.concat(held))
                    held = []
                held.append(own)
        if held:
            yield links_of(pd.concat(held))

    return map_pandas(each.repartition(*together).sortWithinPartitions(*together), run, "src long, dst long")


def later_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5, least: float = 0.8, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id): distinct ids that links lead from to a smaller id. Of rows that share an id, any may link it.

    classes: (doc_id, component_id) of ids that are linked already, all ids of docs; links connect their classes.
    """
    comps = similar_classes(docs, id_col, text_col, words_in_shingle, least, classes)
    if classes is None:
        return comps.where("node > comp").select(F.col("node").alias("doc_id")).distinct()
    last = classes.where("doc_id is not null").join(comps, F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("comp", "component_id").alias("comp"))
    return last.where("doc_id > comp").select("doc_id").distinct()
