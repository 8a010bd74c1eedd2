"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Blanks are ordinary characters of pieces (the vocabulary's whitespace marker), one blank goes before the text, and
characters without a piece fall back to byte pieces, so that decoding gives back every text exactly. No piece has a
blank after another character; so the best segmentation of a text is that of its stretches "blanks, then others" one
by one, and equal stretches are solved once a block, all at once by whole arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, map_arrow, raw_text, table
from .words import pieces as blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
_STRETCH = re.compile(rb" *[^ ]+| +")


class DoubleArray:
    """A trie of byte strings in two arrays: from state s, code c leads to t = base[s] + c if check[t] = s.

    Codes are bytes plus 1; code 0 ends a key, and base of the state it leads to is -1 less the key's number.
    """

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for number, key in enumerate(keys):
            at = root
            for byte in key:
                at = at.setdefault(byte + 1, {})
            at[0] = number
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        self.check[0] = 0
        start, todo = 1, [(0, root)]
        while todo:
            state, own = todo.pop()
            codes = np.fromiter(sorted(own), np.int64)
            at = start
            while True:
                if at + 600 > size:
                    grow = size
                    self.base, self.check, free = np.append(self.base, np.zeros(grow, np.int32)), np.append(self.check, np.full(grow, -1, np.int32)), np.append(free, np.ones(grow, bool))
                    size *= 2
                places = np.flatnonzero(free[at : at + 2048]) + at
                bases = places - codes[0]
                bases = bases[(bases > 0) & (bases + 260 < size)]
                good = bases[free[bases[:, None] + codes].all(axis=1)] if len(bases) else bases
                if len(good):
                    break
                at += 2048
            b = int(good[0])
            self.base[state] = b
            for c in codes.tolist():
                t = b + c
                free[t], self.check[t] = False, state
                if c:
                    todo.append((t, own[c]))
                else:
                    self.base[t] = -1 - own[0]
            while start + 1024 < size and not free[start : start + 1024].any():
                start += 1024

    def matches(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key number) of every key that begins at one of the starts."""
        out, state, at = [], np.zeros(len(starts), np.int64), starts.astype(np.int64)
        begin = at
        while len(begin):
            t = self.base[state] + codes[at]
            go = self.check[t] == state
            begin, at, state = begin[go], at[go] + 1, t[go]
            end = self.base[state].astype(np.int64)
            done = self.check[end] == state
            out.append((begin[done], at[done], -1 - self.base[end[done]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def log_scores(file_scores: np.ndarray) -> np.ndarray:
    """Log scores of the ordinary pieces, best first in the file.

    A unigram vocabulary has them. A merge vocabulary has only ranks (0, -1, -2, ...); its log scores are those of
    the Zipf-Mandelbrot law, log p = -log(rank + 2.7) - log Z. Pieces that merges never form, which such files mark
    with a score far below all ranks, get the least log score.
    """
    rank = np.arange(len(file_scores))
    never = file_scores < -len(file_scores)
    if len(rank) and np.array_equal(file_scores[~never], -rank[~never].astype(np.float32)):
        law = 1 / (rank + 2.7)
        file_scores = np.log(np.where(never, law[-1], law) / law.sum())
    return file_scores.astype(np.float32).astype(np.float64)


class Codec:
    """Encoder and decoder of one vocabulary file; small enough to broadcast (its size is the vocabulary's)."""

    def __init__(self, path: str = VOCABULARY):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        self.text: list[bytes] = [b""] * n
        usual = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(MARKER, " ").encode()
                usual.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        if any(b" " in self.text[i].lstrip(b" ") for i in usual):
            raise ValueError("a piece has a blank after another character")
        self.ids = np.array(usual, np.int32)
        self.scores = log_scores(np.array([model.get_score(i) for i in usual], np.float32))
        self.unknown = float(self.scores.min()) - 10
        self.trie = DoubleArray([self.text[i] for i in usual])

    def solve(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the best segmentations of the stretches, one after another.

        Of equal sums the one whose last differing piece is longer is taken.
        """
        flat = np.frombuffer(b"".join([s + b"\0" for s in stretches]), np.uint8)
        lengths = np.array([len(s) for s in stretches], np.int64)
        heads = np.cumsum(lengths + 1) - lengths - 1
        tails = heads + lengths
        codes = flat.astype(np.int64) + 1
        codes[tails] = 258
        first = (flat & 0xC0) != 0x80
        first[tails] = False
        starts = np.flatnonzero(first)
        begin, end, key = self.trie.matches(codes, starts)
        width = np.full(len(flat), 1, np.int64)
        for least, w in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            width[flat >= least] = w
        single = np.zeros(len(flat), bool)
        single[begin[end - begin == width[begin]]] = True
        lone = starts[~single[starts]]
        owner = np.repeat(np.arange(len(stretches)), lengths + 1)
        begin = np.concatenate([begin, lone])
        end = np.concatenate([end, np.minimum(lone + width[lone], tails[owner[lone]])])
        worth = np.concatenate([self.scores[key], np.full(len(lone), self.unknown)])
        key = np.concatenate([key, np.full(len(lone), -1)])
        place = begin - heads[owner[begin]]
        order = np.argsort(place, kind="stable")
        begin, end, worth, key, place = begin[order], end[order], worth[order], key[order], place[order]
        best = np.full(len(flat), -np.inf)
        best[heads] = 0
        back, via = np.full(len(flat), -1, np.int64), np.full(len(flat), -1, np.int64)
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # edges that begin at one place of a stretch have different ends
            total = best[begin[a:b]] + worth[a:b]
            better = np.flatnonzero(total > best[end[a:b]]) + a
            to = end[better]
            best[to], back[to], via[to] = total[better - a], begin[better], key[better]
        cur, own = tails[lengths > 0], np.flatnonzero(lengths > 0)
        steps = []
        while len(cur):
            steps.append((own, back[cur], cur, via[cur]))
            cur = back[cur]
            left = cur > heads[own]
            cur, own = cur[left], own[left]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(stretches) + 1, np.int64)
        _, a, b, k = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(a)
        a, b, k = a[order], b[order], k[order]
        times = np.where(k < 0, b - a, 1)
        at = np.repeat(a - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        k = np.repeat(k, times)
        ids = np.where(k < 0, self.byte_ids[flat[np.minimum(at, len(flat) - 1)]], self.ids[k])
        return ids.astype(np.int32), np.searchsorted(np.repeat(a, times), np.append(heads, len(flat)))

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, one after another."""
        numbers: dict[bytes, int] = {}
        found, counts = [], []
        for raw in raws:
            own = _STRETCH.findall(b" " + raw) if raw else []
            counts.append(len(own))
            found += [numbers.setdefault(s, len(numbers)) for s in own]
        ids, offsets = self.solve(list(numbers))
        of = np.array(found, np.int64)
        length = (offsets[1:] - offsets[:-1])[of]
        ends = np.cumsum(length)
        flat = ids[np.repeat(offsets[of] - (ends - length), length) + np.arange(int(length.sum()))]
        return flat, np.append(0, ends)[np.append(0, np.cumsum(counts))]

    def decode(self, ids) -> bytes:
        """The text's bytes: pieces put together, without the one blank that encoding puts before a text."""
        text = b"".join([self.text[i] for i in ids])
        return text[1:] if text[:1] == b" " else text


def encode_texts(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, exact) for every row; n_bytes: byte pieces; exact: decoding gives the text back.

    Null or empty text: no ids. Repeated rows and null ids are kept; other columns are ignored; an empty table gives
    no rows. Long texts are solved whole; memory is a block of about 1 MB of text, or one longer text.
    """
    box = fitted(docs.sparkSession, codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = box.value
        is_byte = np.zeros(len(own.text), bool)
        is_byte[own.byte_ids] = True
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            for a, b in blocks(raws):
                ids, offsets = own.encode(raws[a:b])
                exact, listed = [], ids.tolist()
                for raw, i, j in zip(raws[a:b], offsets[:-1].tolist(), offsets[1:].tolist()):
                    exact.append(own.decode(listed[i:j]) == raw)
                at = np.concatenate([[0], np.cumsum(is_byte[ids])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offsets), pa.int64()), pa.array(at[offsets[1:]] - at[offsets[:-1]], pa.int64()), pa.array(exact, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "n_bytes", "exact"],
                )

    rows = raw_text(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return map_arrow(rows, run, "doc_id long, ids array<int>, n_tokens long, n_bytes long, exact boolean")


def decode_ids(tokens: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """tokens' (doc_id, text): the texts of the ids; bytes that are no UTF-8 become replacement characters. Null ids: null."""
    box = fitted(tokens.sparkSession, codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else box.value.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), Codec())
