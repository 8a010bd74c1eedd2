"""Absorption probabilities and times of Markov chains in arrays, right or not given at all.

What is certain (0, 1) is read off the graph. The rest is eliminated without a subtraction, so that rare exits keep their
digits, or is enclosed by a lower and an upper sequence until those meet.
"""

from __future__ import annotations

import numpy as np

#: What bounds on a probability may be apart, and a time's relative error.
GAP, TIME_ERROR = 1e-9, 1e-7
#: Edges times sweeps that one chain may take.
WORK = 2_000_000_000


def backwards(src: np.ndarray, dst: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which nodes have a path into the seed, a mask; itself included."""
    held = seed.copy()
    while True:
        more = held.copy()
        more[src[held[dst]]] = True
        if (more == held).all():
            return held
        held = more


def eliminated(p: np.ndarray, right: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """x = right + p x for stacks of systems: p (k, n, n), right (k, n, c), and gone (k, n), the probability to leave for
    where x is 0; right[..., 0] is that of leaving for where x is 1.

    A node's chance to leave is the sum of where it can go, never 1 less that to stay.
    """
    p, right, gone = p.copy(), right.copy(), gone.copy()
    n = p.shape[1]
    for k in range(n - 1, -1, -1):
        leave = p[:, k, :k].sum(axis=1) + right[:, k, 0] + gone[:, k]
        leave = np.where(leave > 0, leave, 1.0)
        p[:, k, :k] /= leave[:, None]
        right[:, k] /= leave[:, None]
        gone[:, k] /= leave
        if k:
            into = p[:, :k, k]
            p[:, :k, :k] += into[:, :, None] * p[:, None, k, :k]
            right[:, :k] += into[:, :, None] * right[:, None, k]
            gone[:, :k] += into * gone[:, None, k]
    for k in range(1, n):
        right[:, k] += np.einsum("kj,kjc->kc", p[:, k, :k], right[:, :k])
    return right


def enclosed(a: np.ndarray, b: np.ndarray, w: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Probabilities x = into + W x (edges a -> b of weight w) of nodes none of which is sure, nor without hope: the middle
    of two bounds GAP apart at most, nan where they are farther when the sweeps end."""
    n = len(into)
    low, high = np.zeros(n), np.ones(n)
    for _ in range(max(100, WORK // max(1, len(a)))):
        low = into + np.bincount(a, w * low[b], n)
        high = into + np.bincount(a, w * high[b], n)
        if (high - low).max(initial=0.0) <= GAP:
            break
    return np.where(high - low <= GAP, (low + high) / 2, np.nan)


def times(a: np.ndarray, b: np.ndarray, w: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Expected times t = tau + W t of nodes that are sure to arrive, to TIME_ERROR, or nan.

    Sweeps from 0 stay below. Where a sweep adds less than e / (1 + e) tau everywhere, (1 + e) times the last values are
    not raised by a sweep, and so lie above.
    """
    n = len(tau)
    t = np.zeros(n)
    for _ in range(max(100, WORK // max(1, len(a)))):
        new = tau + np.bincount(a, w * t[b], n)
        if ((new - t) <= TIME_ERROR / (1 + TIME_ERROR) * tau).all():
            return new * (1 + TIME_ERROR / 2)
        t = new
    return np.full(n, np.nan)


def absorbed(src: np.ndarray, dst: np.ndarray, rate: np.ndarray, goal: np.ndarray, of: np.ndarray | None = None, dense: int = 3_000, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(probability to reach a goal, expected time; nan where that is not sure, or a value is not found) of every node.

    Edges must not leave goals. `of` numbers the chains that nodes belong to (sorted); those with up to `small` nodes in
    doubt are solved as one stack, up to `dense` as one matrix each, larger ones by sweeps.
    """
    n = len(goal)
    of = np.zeros(n, np.int64) if of is None else of
    total = np.bincount(src, rate, n)
    p = rate / total[src] if len(src) else rate
    can = backwards(src, dst, goal)
    sure = can & ~backwards(src, dst, ~can)
    free = can & ~goal
    h, t = can.astype(float), np.where(sure, 0.0, np.nan)
    tau = np.divide(1.0, total, out=np.zeros(n), where=total > 0)
    into, gone = np.bincount(src[goal[dst]], p[goal[dst]], n), np.bincount(src[~can[dst]], p[~can[dst]], n)
    count = np.bincount(of[free], minlength=int(of.max(initial=0)) + 1)
    before = np.cumsum(free) - free
    first = before[np.searchsorted(of, np.arange(len(count))).clip(max=max(0, n - 1))] if n else before
    place = np.where(free, before - first[of], -1)
    inner = free[src] & free[dst]
    a, b, w = src[inner], dst[inner], p[inner]
    slot = np.full(len(count), -1)
    alone = [np.array([c]) for c in np.flatnonzero((count > small) & (count <= dense))]
    for group in [np.flatnonzero((count > 0) & (count <= small)), *alone]:
        if not len(group):
            continue
        slot[:] = -1
        slot[group] = np.arange(len(group))
        size = int(count[group].max())
        m, right, out = np.zeros((len(group), size, size)), np.zeros((len(group), size, 2)), np.zeros((len(group), size))
        own = slot[of[a]] >= 0
        np.add.at(m, (slot[of[a[own]]], place[a[own]], place[b[own]]), w[own])
        here = np.flatnonzero(free & (slot[of] >= 0))
        at = slot[of[here]], place[here]
        right[at] = np.column_stack([into[here], tau[here]])
        out[at] = gone[here]
        x = eliminated(m, right, out)[at]
        h[here] = np.where(sure[here], 1.0, x[:, 0])
        t[here] = np.where(sure[here], x[:, 1], np.nan)
    number = np.full(n, -1)
    for c in np.flatnonzero(count > dense):
        for nodes, way in ((np.flatnonzero(free & ~sure & (of == c)), "chance"), (np.flatnonzero(free & sure & (of == c)), "time")):
            number[:] = -1
            number[nodes] = np.arange(len(nodes))
            own = (number[a] >= 0) & (number[b] >= 0)
            if way == "time":
                t[nodes] = times(number[a[own]], number[b[own]], w[own], tau[nodes])
            else:
                certain = (number[src] >= 0) & sure[dst]
                h[nodes] = enclosed(number[a[own]], number[b[own]], w[own], np.bincount(number[src[certain]], p[certain], len(nodes)))
    return h, t
