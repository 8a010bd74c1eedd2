"""Deduplication of passages against a log-structured index of window fingerprints.

A window is a number of consecutive words. Of the hashes of the short word groups inside a window, the least one is
the window's anchor, so equal windows have equal anchors, and neighbouring windows mostly share theirs. The index
holds (anchor, document) in sorted immutable runs, one run a batch. A new batch is merge-joined with each run by
anchor; documents that share an anchor are candidates, whose windows are then verified by a second hash over the
windows' own bytes. Runs of one level are compacted into one of the next.

Two windows count as equal if anchor and digest are, two independent 64-bit hashes (polynomials over other bytes'
worths and other bases): windows that differ but share an
anchor are taken for equal with a chance of 2^-64 a pair, so the expected number of errors is at most the number of
pairs of windows under one anchor, over 2^64.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, map_arrow, map_pandas, raw_text, release, remove, shared_dir, stage, table
from .words import gram_hashes, sliding_min, text_word_hashes

WINDOW, GROUP = 13, 6
#: Documents of one anchor from which on its windows meet by aggregation and join instead of by sorted groups.
HOT = 5_000


def window_anchors(hashes: np.ndarray, window: int, group: int) -> np.ndarray:
    """The anchor of the window at each word but the last ones."""
    return sliding_min(gram_hashes(hashes, group), window - group + 1)


def whole_windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of each window that lies in one text, in order; first: as text_word_hashes() has it."""
    n = np.maximum(first[1:] - first[:-1] - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(n) + n, n)


def anchors(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(anchor, doc_id), once for each anchor of a document. docs: (doc_id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for at, to, first, (hashes,) in text_word_hashes(batch.column("raw").to_pylist()):
                text, word = whole_windows(first, window)
                if len(text):
                    least = window_anchors(hashes, window, group)[word]
                    # neighbours mostly share theirs
                    turn = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
                    text, least = text[turn], least[turn]
                    order = np.lexsort((least, text))
                    text, least = text[order], least[order]
                    once = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(least[once].view(np.int64)), pa.array(ids[at:to][text[once]])], ["anchor", "doc_id"])

    return map_arrow(docs, run, "anchor long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of (anchor, doc_id) under a folder, each bucketed and sorted by anchor.

    add() writes a run for a batch and returns the candidates that it makes with itself and with all runs; where
    `fanout` runs have one level, compact() merges them into one run of the next. Equal buckets meet without a
    shuffle. A manifest in the folder, a version of rows (version, level, name, window, group, buckets) at a time,
    says which runs there are: a run counts from when its version is written, so a job that is lost half way leaves
    the index as it was, and open() by another job goes on with it. The folder has to be one that all machines share.
    """

    MANIFEST = "version long, level int, name string, window int, words_in_group int, buckets int"

    def __init__(self, spark: SparkSession, window: int = WINDOW, group: int = GROUP, fanout: int = 2, buckets: int | None = None, path: str | None = None):
        self.spark, self.window, self.group, self.fanout = spark, window, group, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark)}/cellweave/index-{uuid.uuid4().hex}"
        self.version, self.runs = 0, []  # (level, name)

    @staticmethod
    def open(spark: SparkSession, path: str, fanout: int = 2) -> FingerprintIndex:
        """The index that an earlier job left in the folder, as its last version has it."""
        rows = spark.read.schema(FingerprintIndex.MANIFEST).json(f"{path}/manifest").collect()  # a row a run and version
        last = [r for r in rows if r.version == max(r.version for r in rows)]
        if not last:
            raise ValueError(f"no index in {path}")
        index = FingerprintIndex(spark, last[0].window, last[0].words_in_group, fanout, last[0].buckets, path)
        index.version, index.runs = last[0].version, [(r.level, r.name) for r in last if r.name]
        for _, name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'")
        return index

    def _write(self, rows: DataFrame) -> str:
        name = f"cellweave_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """runs are the index from here on; runs that went are deleted."""
        gone = {name for _, name in self.runs} - {name for _, name in runs}
        self.version, self.runs = self.version + 1, runs
        rows = [(self.version, level, name, self.window, self.group, self.buckets) for level, name in runs or [(0, None)]]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        for name in gone:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, anchor, n) of each document, old or new, that shares an anchor with another one of the batch or
        with a historical one; pairs among historical documents came with earlier batches. n: the anchor's documents
        in that document's run. docs: (doc_id, raw)."""
        found = anchors(docs, self.window, self.group).repartition(self.buckets, "anchor")
        new = self.spark.table(name := self._write(found))
        del found
        release(self.spark)  # no frame holds the run's shuffle any more
        count = lambda run, n: run.groupBy("anchor").agg(F.count(F.lit(1)).alias(n), (F.min("doc_id") != F.max("doc_id")).alias(f"many_{n}"))
        ours, out = count(new, "n"), None
        near = F.col("many_n")
        for i, (_, run) in enumerate(self.runs):
            old, theirs = self.spark.table(run), count(self.spark.table(run), f"n{i}")
            met = old.join(theirs.join(count(new, "n"), "anchor", "left_semi"), "anchor").select("doc_id", "anchor", F.col(f"n{i}").alias("n"))
            out = met if out is None else out.union(met)
            ours, near = ours.join(theirs, "anchor", "left"), near | F.col(f"n{i}").isNotNull()
        met = new.join(ours.where(near), "anchor").select("doc_id", "anchor", "n")
        out = met if out is None else out.union(met)
        out = stage(out.repartition("doc_id"), "candidates")  # few files of some size, not a small one a bucket
        self._commit([*self.runs, (0, name)])
        return out

    def compact(self) -> None:
        """Merge runs while a level holds `fanout` of them."""
        while levels := [k for k in {k for k, _ in self.runs} if sum(x == k for x, _ in self.runs) >= self.fanout]:
            level = min(levels)
            rows = None
            for k, name in self.runs:
                if k == level:
                    rows = self.spark.table(name) if rows is None else rows.union(self.spark.table(name))
            merged = self._write(rows.repartition(self.buckets, "anchor"))
            release(self.spark)
            self._commit([*(x for x in self.runs if x[0] != level), (level + 1, merged)])

    def close(self) -> None:
        """Forget the tables of this session; the folder stays for open()."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def remove(self) -> None:
        """Delete the index."""
        self.close()
        remove(self.spark, self.path)


def candidate_lists(candidates: DataFrame, runs: int) -> DataFrame:
    """(doc_id, usual, hot): each document's candidate anchors. candidates: (doc_id, anchor, n) of so many runs.

    An anchor is hot if one run has HOT / runs of its documents or more; so one that is not has fewer than HOT.
    """
    hot = candidates.where(F.col("n") * runs >= HOT).select("anchor").distinct().withColumn("is_hot", F.lit(True))
    known = candidates.join(hot, "anchor", "left")
    return known.groupBy("doc_id").agg(*(F.collect_set(F.when(F.col("is_hot").isNotNull() == flag, F.col("anchor"))).alias(name) for name, flag in (("usual", False), ("hot", True))))


def _packed(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """A binary array: runs of values that begin at heads, each as its bytes."""
    ends = np.append(heads, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(number of values of each row, values)"""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(held[int(ends[0]) : int(ends[-1])], kind) if held is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return np.diff(ends) // size, values


def candidate_windows(docs: DataFrame, lists: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(anchor, doc_id, at, digests) for each stretch of windows with one anchor that is in the document's list.

    digests: 8 bytes a window, a hash of its words that is independent of the anchor's. lists: (doc_id, shared).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column("doc_id").to_numpy(), batch.column("shared")
            wanted, ends = shared.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(shared).to_numpy())])
            for at, to, first, (hashes, others) in text_word_hashes(batch.column("raw").to_pylist(), keys=(0, 1)):
                text, word = whole_windows(first, window)
                if not len(text):
                    continue
                least = window_anchors(hashes, window, group).view(np.int64)[word]
                own = wanted[ends[at] : ends[to]]
                # (text, anchor) as one number each: the anchor's place among those of these texts
                names = np.unique(own)
                place = np.searchsorted(names, least)
                known = np.minimum(place, len(names) - 1)
                pairs = np.unique(np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])) * len(names) + np.searchsorted(names, own))
                asked = text * len(names) + known
                found = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
                near = np.flatnonzero((names[known] == least) & (pairs[found] == asked))
                if not len(near):
                    continue
                text, word, least = text[near], word[near], least[near]
                digests = gram_hashes(others, window, 1)[word]
                heads = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1] + 1) | (text[1:] != text[:-1]) | (least[1:] != least[:-1])]))
                places = (word - first[text])[heads].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(least[heads]), pa.array(ids[at:to][text[heads]]), pa.array(places), _packed(digests, heads)], ["anchor", "doc_id", "at", "digests"])

    return map_arrow(docs.join(lists, "doc_id"), run, "anchor long, doc_id long, at int, digests binary")


def _later(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
    """(doc_id, starts) of the windows that a smaller document of the same anchor has too."""
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + at[row]
    order = np.lexsort((doc[row], digest, anchor[row]))
    a, g, d = anchor[row][order], digest[order], doc[row][order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])])[: len(a)]
    low = d[head][np.cumsum(head) - 1]
    late = d > low
    d, p = d[late], place[order][late].astype(np.int32)
    order = np.argsort(d, kind="stable")
    d, p = d[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])[: len(d)])
    return pa.RecordBatch.from_arrays([pa.array(d[cut]), _packed(p, cut)], ["doc_id", "starts"])


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, starts) with 4 bytes for each window that a smaller document has too; several rows a document.

    Windows meet by anchor, sorted, and go through memory one group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy() for c in ("anchor", "doc_id", "at")] + list(_unpacked(batch.column("digests"), np.uint64)))
            last = held[-1][0][-1]
            # groups are many and small: take up some rows before a pass over them; the last group may go on
            if sum(len(x[0]) for x in held) >= 20_000 and held[0][0][0] != last:
                parts = [np.concatenate(x) for x in zip(*held)]
                full = int(np.argmax(parts[0] == last))
                n = int(parts[3][:full].sum())
                yield _later(*(x[:full] for x in parts[:4]), parts[4][:n])
                held = [[x[full:] for x in parts[:4]] + [parts[4][n:]]]
        if held:
            yield _later(*(np.concatenate(x) for x in zip(*held)))

    return map_arrow(windows.repartition("anchor").sortWithinPartitions("anchor"), run, "doc_id long, starts binary")


def repeated_hot_windows(windows: DataFrame) -> DataFrame:
    """The same for hot anchors. Documents that share a passage mostly share whole stretches, so equal stretches are
    aggregated first, partly before the shuffle; windows meet by aggregation and join among distinct stretches; and
    each document's stretch then gets its windows' smallest documents by a join that AQE can split."""
    windows, key = stage(windows, "hot-windows"), ["anchor", "digests"]
    at = F.sequence(F.lit(0), (F.length("digests") / 8).cast("int") - 1)
    distinct = windows.groupBy(*key).agg(F.min("doc_id").alias("low"))
    each = distinct.select(*key, "low", F.explode(at).alias("k")).withColumn("digest", F.substring(F.col("digests"), F.col("k") * 8 + 1, F.lit(8)))
    least = each.groupBy("anchor", "digest").agg(F.min("low").alias("least"))
    lows = each.join(least, ["anchor", "digest"]).groupBy(*key).agg(F.collect_list(F.struct("k", "least")).alias("lows"))

    def little(n):  # four bytes, the lowest first, as the other path has them
        h = F.lpad(F.hex(n), 8, "0")
        return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))

    late = F.filter("lows", lambda x: F.col("doc_id") > x["least"])
    starts = F.unhex(F.array_join(F.transform("late", lambda x: little(F.col("at") + x["k"])), ""))
    return windows.join(lows, key).select("doc_id", "at", late.alias("late")).where(F.size("late") > 0).select("doc_id", starts.alias("starts"))


def _apply(raw: bytes, starts, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space)"""
    words = raw.split()
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    p = np.unique(np.frombuffer(b"".join(starts), np.int32))
    np.add.at(gone, p, 1)
    np.add.at(gone, p + window, -1)
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), b" ".join(compress(words, keep.tolist()))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs; kept: the remaining words joined by one space.

    A word goes if a window covers it whose words also start in a document with a smaller id. docs are fed to the
    index in `batches` ascending ranges of ids, of about as many rows each. To go on with an index from earlier calls,
    give it and the earlier documents as `history` (all their ids smaller; their words are sources only). Without one,
    the index is deleted once the candidates are known.

    Fewer words than a window, or null or empty text: nothing goes (kept is empty where there are no words). Null id:
    the row stays as it is and is no source. Rows that repeat an id are one document's: each keeps what no smaller id
    has. Any long is an id. Extra columns are ignored. Memory: batches of texts, and for the longest text some ten
    bytes a byte.
    """
    spark = docs.sparkSession
    rows = raw_text(docs, text_col, long_id(docs, id_col))
    own, index = index is None, index or FingerprintIndex(spark, window, group)
    known = rows.where("doc_id is not null")
    inner = [i / batches for i in range(1, batches)]
    n_known, cuts = known.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", inner or [0.5], 10_000)).first()
    # every batch but the first holds the ids above a cut, and every batch but the last those up to one
    cuts = sorted(set(cuts or [])) if inner else []
    candidates, parts = None, len(index.runs)
    for low, high in zip([None, *cuts], [*cuts, None]) if n_known else ():
        part = known if low is None else known.where(F.col("doc_id") > low)
        more = index.add(part if high is None else part.where(F.col("doc_id") <= high))
        index.compact()
        candidates = more if candidates is None else candidates.union(more)
    parts += len(cuts) + 1
    if own:
        index.remove()
    if candidates is None:
        starts = spark.createDataFrame([], "doc_id long, starts binary")
    else:
        texts = known if history is None else known.union(raw_text(history, text_col, long_id(history, id_col)))
        lists = stage(candidate_lists(candidates, parts), "candidate-lists")
        usual, hot = (candidate_windows(texts, lists.where(F.size(x) > 0).select("doc_id", F.col(x).alias("shared")), window, group) for x in ("usual", "hot"))
        starts = repeated_windows(usual).union(repeated_hot_windows(hot))
    covers = starts.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            done = [_apply(raw, s, window) for raw, s in zip(part["raw"], part["starts"])]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_words": [x[0] for x in done], "n_removed": [x[1] for x in done], "kept": [x[2].decode("utf-8", "replace") for x in done]})

    # the same exchange of the texts serves the windows and this join; rows without an id need neither
    judged = known.join(covers, "doc_id", "left").unionByName(rows.where("doc_id is null").withColumn("starts", F.lit(None).cast("array<binary>")))
    return map_pandas(judged, run, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, list_slice(w, p, p + 12) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY x) AS low FROM windows) WHERE doc_id > low
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM late, (SELECT unnest(range(13)) AS k)
), each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
