"""Quality classification by voting of nearest neighbours among labelled latent-semantic vectors.

Texts become weighted counts of hashed terms: words, and marks of form such as letter case, punctuation and
repetition. Latent-semantic vectors are their projections on the leading directions of a bounded labelled sample.
The sample's vectors are broadcast; every text's cosines with all of them are computed exactly, block by block, and
the labels of its nearest ones vote with their similarities as weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, fold, labelled_texts, map_pandas, table

DIMS, RANK, NEIGHBOURS, BLOCK = 2048, 48, 25, 128
_MARKS = "|#*$%&<>!?.,;:@/()[]{}=+-_~\"'"


def form(word: str) -> str:
    """The word's form: case, the kinds of its other characters, and a length class."""
    case = "u" if word.isupper() else "l" if word.islower() else "t" if word.istitle() else "m"
    digits = "9" if any(map(str.isdigit, word)) else ""
    tail = word[-1] if not word[-1].isalnum() else ""
    head = word[0] if not word[0].isalnum() else ""
    return f"\x00{case}{digits}{head}{tail}{min(len(word), 24) // 4}"


def terms(text: str | None) -> dict[int, float]:
    """Hashed terms with their weights (1 + log of the count)."""
    text = text or ""
    words = text.split()
    if not words:
        return {}
    seen = Counter(words)
    count: dict[int, int] = {}
    for w, n in seen.items():
        for t in (w.lower(), form(w)):
            k = zlib.crc32(t.encode("utf-8", "surrogatepass")) % DIMS
            count[k] = count.get(k, 0) + n
    n = len(words)
    rates = [("same", sum(a == b for a, b in zip(words, words[1:])) / n), ("kinds", 1 - len(seen) / n), *((c, text.count(c) / n) for c in _MARKS), ("upper", sum(n for w, n in seen.items() if w.isupper() and len(w) > 1) / n)]
    out = {k: 1 + np.log(v) for k, v in count.items()}
    for name, rate in rates:
        if rate > 0:
            # shares of the text in tenths count as terms of their own, so that form weighs besides vocabulary
            out[zlib.crc32(f"\x01{name}{min(int(rate * 10), 12)}".encode()) % DIMS] = 3 + np.log(1 + 10 * rate) * 2
    return out


def matrix(found: list[dict[int, float]]) -> np.ndarray:
    out = np.zeros((len(found), DIMS), np.float32)
    for row, own in zip(out, found):
        if own:
            row[np.fromiter(own, np.int64, len(own))] = np.fromiter(own.values(), np.float32, len(own))
    return out


class Model:
    """Term weights, directions, and the labelled unit vectors."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.idf, self.directions, self.vectors, self.labels, self.prior = idf, directions, vectors, labels, prior

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of label 1 among the nearest by similarity; the labels' own share where nothing is similar. Of
        neighbours that are equally similar those with the smaller ids come first."""
        out = []
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            own = self.embed(matrix([terms(t) for t in texts[i : i + BLOCK]]))
            if not k:
                out.append(np.full(len(own), self.prior))
                continue
            cosine = own @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(cosine, near, axis=1).min(axis=1)
            for j in np.flatnonzero((cosine >= last[:, None]).sum(axis=1) > k):
                tied = np.flatnonzero(cosine[j] >= last[j])
                near[j] = tied[np.argsort(-cosine[j][tied], kind="stable")[:k]]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(float), 0) ** 4
            total = weight.sum(axis=1)
            out.append(np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit(train: DataFrame) -> Model:
    """Fit on (doc_id, label, text), a sample that the caller has bounded; its sparse vectors go to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [terms(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "at": [np.fromiter(x, np.int16, len(x)).tobytes() for x in found], "w": [np.fromiter(x.values(), np.float32, len(x)).tobytes() for x in found]})

    rows = map_pandas(train, run, "doc_id long, label int, at binary, w binary").toPandas().sort_values("doc_id")
    labels = rows["label"].to_numpy(np.int64)
    x = matrix([dict(zip(np.frombuffer(a, np.int16).tolist(), np.frombuffer(w, np.float32).tolist())) for a, w in zip(rows["at"], rows["w"])])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = x * idf
    rank = min(RANK, DIMS)
    _, directions = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    model = Model(idf, np.ascontiguousarray(directions[:, ::-1][:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), labels, float(labels.mean()) if len(labels) else 0.5)
    model.vectors = model.embed(x)
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row. Whole texts are read.

    Null or empty text: the share of label 1 among the labelled. Repeated rows and null ids are kept; other columns
    are ignored; an empty table gives no rows. A very long text is read as a whole, and comes to one vector of fixed
    length. Memory is one block of texts by the labelled vectors, and some 60 bytes a word of one text.
    """
    box = fitted(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": box.value.score(list(part["text"]))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_pandas(rows, run, "doc_id long, score double")


def op9_quality_classifier(spark, sf_dir: str, most: int = 6_000) -> DataFrame:
    """Learns from at most `most` labelled texts of the training folds."""
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", most)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
