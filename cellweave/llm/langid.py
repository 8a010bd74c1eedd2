"""Language identification by rank-order n-gram profiles and the out-of-place distance (Cavnar and Trenkle).

Texts are lowered; all but letters part tokens; n-grams of one to three characters are counted within tokens padded
by a blank on either side. A profile lists the most frequent n-grams by rank. The distance of a text to a language
is the sum, over the text's own most frequent n-grams, of how far the ranks lie apart; a missing one costs the most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fitted, fold, map_arrow, map_pandas, stage, table

RANKS = 300
_BLANK = 32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def characters(text: str | None) -> np.ndarray:
    """Code points of the lowered text between two blanks, with a blank for all that is no letter."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letter_table()[points], points, _BLANK)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text's n-grams. A code holds 21 bits a character, first character highest; shorter
    n-grams have zeros above, so codes order n-grams the same way in every text."""
    letter = points != _BLANK
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet, small = np.unique(points, return_inverse=True)
    a, b, c = small[:-2], small[1:-1], small[2:]
    size = len(alphabet) + 1
    middle = letter[1:-1]
    one = small[letter] + 1
    two = (small[:-1] + 1) * size + small[1:] + 1
    two = two[letter[:-1] | letter[1:]]
    three = ((a + 1) * size + b + 1) * size + c + 1
    three = three[middle]
    if size**3 <= 1 << 21 and len(points) > 200:
        times = np.bincount(np.concatenate([one, two, three]))
        codes = np.flatnonzero(times)
        times = times[codes]
    else:
        codes, times = np.unique(np.concatenate([one, two, three]), return_counts=True)
    wide = np.append(0, alphabet.astype(np.int64))
    x, rest = np.divmod(codes, size * size)
    y, z = np.divmod(rest, size)
    return (wide[x] << 42) | (wide[y] << 21) | wide[z], times


def top_grams(text: str | None, ranks: int = RANKS) -> np.ndarray:
    """Codes by rank: the most frequent first, equal counts by code."""
    codes, times = grams(characters(text))
    return codes[np.lexsort((codes, -times))[:ranks]]


class Profiles:
    """For each language, the rank of each n-gram of its profile."""

    def __init__(self, ranked: dict[str, np.ndarray], ranks: int = RANKS):
        self.langs, self.ranks = sorted(ranked), ranks
        self.codes = np.unique(np.concatenate([np.asarray(ranked[x], np.int64) for x in self.langs])) if ranked else np.zeros(0, np.int64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, np.asarray(ranked[x], np.int64))] = np.arange(len(ranked[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, likeness): 1 less the share of the largest possible distance; ties go to the first name."""
        own = top_grams(text, self.ranks)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own), at, len(self.codes))
        theirs = self.rank[:, at]
        apart = np.where(theirs < 0, self.ranks, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (self.ranks * len(own))


def fitting_rows(rows: DataFrame, per_lang: int | None = 1_000) -> DataFrame:
    """(lang, text) of about per_lang of each language's rows in (doc_id, text, lang), those of smallest MD5 of their
    id; None: of all rows. Null languages are left out."""
    rows = rows.where("lang is not null")
    if per_lang is None:
        return rows.select("lang", "text")
    sizes = stage(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share")), "langs")
    digest = F.md5(F.concat(F.lit("langid:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return rows.join(sizes, "lang").where(u < F.col("share")).select("lang", "text")


def fit_profiles(rows: DataFrame, per_lang: int | None = 1_000, ranks: int = RANKS) -> Profiles:
    """Profiles from (doc_id, text, lang): from the rows of fitting_rows(), about per_lang of each language or all.

    The counts stay distributed; `ranks` n-grams a language reach the driver. A language whose rows have no letter has
    no profile. Rows that repeat an id all count.
    """
    chosen = fitting_rows(rows, per_lang)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lang, own in part.groupby("lang"):
                codes, times = zip(*(grams(characters(t)) for t in own["text"]))
                total = pd.Series(np.concatenate(times)).groupby(np.concatenate(codes)).sum()
                if len(total):
                    yield pd.DataFrame({"lang": lang, "code": total.index.to_numpy(), "n": total.to_numpy()})

    counted = map_pandas(chosen, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ranks).toPandas()
    return Profiles({x: own.sort_values("r")["code"].to_numpy() for x, own in top.groupby("lang")}, ranks)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs. Whole texts are counted.

    Null text, or one without a letter: 'und' and 0. Repeated rows and null ids are kept; other columns are ignored;
    an empty table gives no rows. Memory: some 60 bytes a character of the longest text.
    """
    box = fitted(docs.sparkSession, profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [box.value.predict(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_pandas(rows, run, "doc_id long, lang_pred string, score double")


#: Likenesses are told apart to one part in so many where they are counted.
STEPS = 100_000


def least_likeness(rows: DataFrame, profiles: Profiles, share: float = 0.001, part: float = 0.5) -> float:
    """A likeness below which a text is in none of the languages: a part of what the least alike `share` of all rows with
    a language reach. 0 where there is no row.

    Every row is scored and counted, by its likeness in STEPS; those counts, no rows, reach the driver.
    """
    box = fitted(rows.sparkSession, profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"step": [int(x * STEPS) for lang, x in map(box.value.predict, batch["text"]) if lang != "und"]}, dtype="int64")

    counts = map_pandas(fitting_rows(rows, None), run, "step long").groupBy("step").count().orderBy("step").toPandas()
    if counts.empty:
        return 0.0
    upto = counts["count"].cumsum().to_numpy()
    return part * float(counts["step"].iloc[int(np.searchsorted(upto, share * upto[-1]))]) / STEPS


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """docs without the rows whose language can't be told: those without a letter, and those less alike than `least`
    to every language. lang_col, where docs have it as a string, gets the language that was told.

    Without any profile rows with a letter stay, with the language that they have. Other columns stay as they are.
    """
    box = fitted(docs.sparkSession, profiles)
    at = docs.columns.index(lang_col) if dict(docs.dtypes).get(lang_col) == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(text_col).to_pylist(), box.value
            if known.langs:
                found = [known.predict(t) for t in texts]
                if at is not None:
                    column = batch.column(at)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([x for x, _ in found], column.type))
                stay = [lang != "und" and score >= least for lang, score in found]
            else:
                stay = [bool((characters(t) != _BLANK).any()) for t in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text, lang) of the training folds: crc32 of the id modulo 4 is not 2."""
    return docs.where(fold(id_col, 4) != 2).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_profiles(training_rows(docs)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


# CRC-32 of a decimal number, byte by byte over its table, since the dialect has no function for it.
OP8_SQL = r"""
WITH RECURSIVE ct(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM ct WHERE k < 8
), crc AS MATERIALIZED (SELECT i, c FROM ct WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, lower(coalesce(text, '')) AS t, lang FROM documents),
cr(name, pos, c) AS (
  SELECT DISTINCT name, 1, 4294967295::BIGINT FROM d UNION ALL
  SELECT name, pos + 1, xor(cr.c >> 8, crc.c) FROM cr JOIN crc ON crc.i = xor(cr.c & 255, ord(substr(name, pos, 1))) WHERE pos <= length(name)
), fold AS MATERIALIZED (SELECT name, xor(c, 4294967295) % 4 AS f FROM cr WHERE pos = length(name) + 1),
tok AS MATERIALIZED (SELECT rid, tok, count(*) AS n FROM (SELECT rid, unnest(regexp_extract_all(t, '\p{L}+')) AS tok FROM d) GROUP BY ALL),
pos AS (SELECT rid, ' ' || tok || ' ' AS p, n, length(tok) AS m, unnest(range(1, length(tok) + 2)) AS k FROM tok),
gr AS MATERIALIZED (SELECT rid, g, sum(n) AS n FROM (
  SELECT rid, substr(p, k + 1, 1) AS g, n FROM pos WHERE k <= m UNION ALL
  SELECT rid, substr(p, k, 2), n FROM pos UNION ALL
  SELECT rid, substr(p, k, 3), n FROM pos WHERE k <= m) GROUP BY ALL),
train AS (SELECT rid, lang, name FROM d JOIN fold USING (name) WHERE f <> 2 AND lang IS NOT NULL),
share AS (SELECT lang, least(1.0, 1000.0 / count(*)) AS share FROM train GROUP BY lang),
chosen AS (SELECT rid, lang FROM train JOIN share USING (lang) WHERE CAST(('0x' || substr(md5('langid:' || name), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 < share),
prof AS MATERIALIZED (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r FROM chosen JOIN gr USING (rid) GROUP BY lang, g) WHERE r < 300),
own AS MATERIALIZED (SELECT rid, g, r FROM (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, length(g), g) - 1 AS r FROM gr) WHERE r < 300),
met AS (SELECT own.rid, prof.lang, sum(300 - abs(own.r - prof.r)) AS near FROM own JOIN prof ON prof.g = own.g GROUP BY ALL),
apart AS (SELECT n.rid, l.lang, 300 * n.n - coalesce(near, 0) AS dist, n.n FROM (SELECT rid, count(*) AS n FROM own GROUP BY rid) n CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN met ON met.rid = n.rid AND met.lang = l.lang),
best AS (SELECT rid, lang, 1 - dist / (300.0::DOUBLE * n) AS score FROM apart QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, lang) = 1)
SELECT doc_id, f = 2 AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0)::DOUBLE AS score FROM d JOIN fold USING (name) LEFT JOIN best USING (rid)
"""
