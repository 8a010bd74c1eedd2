"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens score their log-odds between toxic and clean labelled texts under a Dirichlet prior, shrunk by its standard
error; every token pays a small fee, so that clean text drifts down. A linear scan finds all maximal segments. A
segment of score S in n tokens is significant by extreme-value theory: the expected number of segments at least as
high is K n exp(-lambda S). The significant segments' surplus adds up and is calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, fold, labelled_texts, map_pandas, table

_PART = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’¿¡«»…"})
_EMPTY = (0, 0.0, [])


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().translate(_PART).split()


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear-time method of Ruzzo and Tompa."""
    found: list[list] = []  # start, end, sum before, sum after, nearest earlier candidate with a smaller sum before
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        own = [i, i + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                own[4] = j
                found.append(own)
                break
            own = [found[j][0], own[1], found[j][2], own[3], -1]
            del found[j:]
    return [(s, e, r - lo) for s, e, lo, r, _ in found]


class Model:
    """Token scores, the fee, the two parameters of the extreme-value law, and the calibration."""

    def __init__(self, scores: dict[str, float], fee: float, lam: float, k: float, a: float = 1.0, b: float = 0.0):
        self.scores, self.fee, self.lam, self.k, self.a, self.b = scores, fee, lam, k, a, b

    def segments(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """(tokens, best score, maximal segments)"""
        own = tokens(text)
        get, fee = self.scores.get, self.fee
        line = np.array([get(w, 0.0) for w in own]) - fee
        if not len(own) or line.max() <= 0:
            return len(own), 0.0, []
        found = maximal_segments(line.tolist())
        return len(own), max(s for *_, s in found), found

    def surplus(self, n: int, segments: list[tuple[int, int, float]], level: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
        """The significant segments and the sum of -log of their expected numbers."""
        floor = math.log(max(self.k * n, 1e-12))
        kept = [(s, e, self.lam * x - floor) for s, e, x in segments if self.lam * x - floor > -math.log(level)]
        return sum(x for *_, x in kept), kept

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(probability, tokens, significant segments with their -log expected number)"""
        n, _, found = self.segments(text)
        total, kept = self.surplus(n, found) if found else (0.0, [])
        return _sigmoid(self.a * math.log1p(total) + self.b), n, kept


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum(weights * exp(lambda * values)) = 1."""
    low, high = 1e-6, 1e-6
    f = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(train: DataFrame, max_terms: int = 50_000, prior: float = 500.0, least_prior: float = 0.5, z_least: float = 2.5, fee: float = 1.0, min_count: int = 3) -> Model:
    """Fit on (label, text), a sample that the caller has bounded. At most max_terms token scores reach the driver.

    A token's prior count is least_prior plus `prior` times its share of all tokens. A token scores sign(d) * max(0, |d| - se), where it
    is at least z_least standard errors from 0, and 0 otherwise. No toxic or no clean text: no token scores.
    """
    spark = train.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for part in batches:
            for label, text in zip(part["label"], part["text"]):
                by[int(label)].update(set(tokens(text)))  # once a text: one that repeats a word is one witness
        for label, own in enumerate(by):
            if own:
                yield pd.DataFrame({"token": list(own.keys()), "label": label, "n": list(own.values())})

    each = map_pandas(train, count, "token string, label int, n long").groupBy("token").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0")).persist()
    n1, n0 = (float(x or 0) for x in each.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        each.unpersist()
        return Model({}, fee, 1.0, 1.0, 1.0, -3.0)
    y1, y0 = F.col("y1"), F.col("y0")
    share = F.lit(least_prior) + F.lit(prior) * (y1 + y0) / (n1 + n0)
    total = prior + least_prior * each.count()
    delta = F.log((y1 + share) / (n1 + total - y1 - share)) - F.log((y0 + share) / (n0 + total - y0 - share))
    se = F.sqrt(1 / (y1 + share) + 1 / (y0 + share))
    chosen = each.where(y1 + y0 >= min_count).select("token", "y0", delta.alias("d"), se.alias("se")).where(F.abs("d") >= z_least * F.col("se")).orderBy(F.desc(F.abs(F.col("d")) / F.col("se")), "token").limit(max_terms).toPandas()
    each.unpersist()
    worth = np.sign(chosen["d"]) * np.maximum(0, np.abs(chosen["d"]) - chosen["se"])
    scores = {t: float(x) for t, x in zip(chosen["token"], worth) if x}
    clean = (chosen["y0"].to_numpy() + 0.5) / (n0 + 0.5 * len(chosen) + 1)
    values = np.append(worth.to_numpy() - fee, -fee)
    lam = _root(values, np.append(clean, max(0.0, 1 - clean.sum()))) if (values > 0).any() else 1.0
    model = Model(scores, fee, lam, 1.0)
    box = fitted(spark, model)

    # two numbers a text, then one, reach the driver; its segments stay where they are found
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [box.value.segments(t) for t in part["text"]]
            yield pd.DataFrame({"label": part["label"], "n": [x[0] for x in found], "best": [float(x[1]) for x in found]})

    seen = map_pandas(train, best, "label int, n long, best double").toPandas()
    label, n = seen["label"].to_numpy(), seen["n"].to_numpy()
    low = (label == 0) & (n > 0)
    model.k = float(low.sum() / max((n[low] * np.exp(-lam * seen["best"].to_numpy()[low])).sum(), 1e-9)) if low.any() else 1.0
    tail = fitted(spark, model)

    def surplus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [tail.value.segments(t) for t in part["text"]]
            yield pd.DataFrame({"label": part["label"], "x": [float(tail.value.surplus(n, own)[0]) for n, _, own in found]})

    over = map_pandas(train, surplus, "label int, x double").toPandas()
    x, label = np.log1p(over["x"].to_numpy()), over["label"].to_numpy()
    model.a, model.b = _logistic(x, label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a slight ridge; the classes weigh alike."""
    w = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    t = np.where(y == 1, 1 - 1e-3, 1e-3)
    m, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        g = m.T @ (w * (t - p)) - 1e-2 * beta
        h = (m * (w * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_tokens, passages) for every row; passages: array of (start, end, surprise), in tokens.

    Null or empty text: no passages, the score of no evidence. Repeated rows and null ids are kept; other columns are
    ignored; an empty table gives no rows. Memory is one text's tokens.
    """
    box = fitted(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [box.value.score(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": [x[0] for x in found], "n_tokens": [x[1] for x in found], "passages": [[{"start": s, "end": e, "surprise": v} for s, e, v in x[2]] for x in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_pandas(rows, run, "doc_id long, score double, n_tokens long, passages array<struct<start:int,end:int,surprise:double>>")


def op3_toxicity(spark, sf_dir: str, most: int = 20_000) -> DataFrame:
    """Learns from at most `most` labelled texts of the training folds."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", most))
    found = toxic_passages(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
