"""Words of many texts at once: spans and 64-bit hashes by whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: \x20 and \x09-\x0D part words; all other bytes belong to one.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(raws: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes together; a longer text stands alone."""
    at, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > limit:
            yield at, i
            at, size = i, 0
        size += len(raw)
    if at < len(raws):
        yield at, len(raws)


def spans(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, first): the texts' bytes with a space after each, the words' spans in it, and for each
    text the number of its first word, with the number of all words at the end."""
    buf = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    return buf, starts, ends, np.searchsorted(starts, offsets)


#: Two hash functions of words: the worth of each byte, and a base (odd).
_draws = np.random.default_rng(42).integers(0, 1 << 64, 257, np.uint64)
_KEYS = ((np.arange(1, 257, dtype=np.uint64), _BASE), (_draws[:256], _draws[256] | np.uint64(1)))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _powers_of(key: int, inverse: bool, n: int) -> np.ndarray:
    """1, b, b^2, ... of a base or its inverse modulo 2^64, n at least; kept between calls up to a megabyte's worth."""
    held = _powers.get((key, inverse))
    if held is None or len(held) < n:
        base = int(_KEYS[key][1])
        held = np.full(max(n, 1 << 12), np.uint64(pow(base, -1, 1 << 64) if inverse else base), np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 20:
            _powers[key, inverse] = held
    return held


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of each word's bytes: a polynomial modulo 2^64, mixed with the length. key: which of two functions."""
    worth = _KEYS[key][0][buf]
    worth *= _powers_of(key, False, len(buf))[: len(buf)]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(worth, out=total[1:])
    return mix((total[ends] - total[starts]) * _powers_of(key, True, len(buf) + 1)[starts] + (ends - starts).astype(np.uint64))


def cut_points(raw: bytes, limit: int) -> list[int]:
    """Where to part a text into pieces of about `limit` bytes without parting a word; a longer word is one piece."""
    cuts, at = [0], 0
    while len(raw) - at > limit:
        near = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8, limit, at)])
        step = int(near[-1]) + 1 if len(near) else limit
        while not len(near) and at + step < len(raw):
            near = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8, min(limit, len(raw) - at - step), at + step)])
            step += int(near[0]) + 1 if len(near) else min(limit, len(raw) - at - step)
        at += step
        cuts.append(at)
    return [*cuts, len(raw)] if cuts[-1] < len(raw) or not raw else cuts


def text_word_hashes(raws: list[bytes], keys: tuple[int, ...] = (0,), limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(from, to, first, hashes) for ranges of texts: for each text the number of its first word, with the number of
    all at the end, and for each key the words' hashes. Some 50 bytes of memory a byte go to `limit` bytes at a time,
    or to one longer word; a longer text costs 8 bytes a word and key besides."""
    for at, to in pieces(raws, limit):
        if to - at == 1 and len(raws[at]) > limit:
            cuts = cut_points(raws[at], limit)
            parts = [[word_hashes(*own[:3], k) for k in keys] for a, b in zip(cuts, cuts[1:]) for own in (spans([raws[at][a:b]]),)]
            hashes = [np.concatenate(x) for x in zip(*parts)]
            yield at, to, np.array([0, len(hashes[0])]), hashes
        else:
            buf, starts, ends, first = spans(raws[at:to])
            yield at, to, first, [word_hashes(buf, starts, ends, k) for k in keys]


def gram_hashes(words: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """A hash of each n consecutive values (of len(words) - n + 1 places)."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _KEYS[key][1]
        out += words[j : j + m]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else (x[:0] if rest else x)
