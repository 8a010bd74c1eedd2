"""Quality rules whose cutoffs are chosen with a guarantee on false rejections.

Each rule rejects a text whose statistic exceeds a cutoff. For each rule and stratum, cutoffs are tried from loose
to strict on labelled holdouts: a cutoff passes if the exact binomial tail shows that it rejects no more than the
allowed share of good texts. Testing stops at the first cutoff that does not pass (a fixed sequence), and the error
probability is divided among rules and strata (Bonferroni), so that with the stated confidence no stratum loses more
than `risk` of its good texts to the rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_labels, map_pandas, stage, table

SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "[#*$%&|<>]"
#: Statistics, each with its cutoffs from loose to strict.
GRID = tuple(x / 100 for x in (90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10, 8, 6, 5, 4, 3, 2))
RULES: dict[str, tuple[float, ...]] = {
    "symbol_rate": GRID, "repeat_rate": GRID, "dup_line_rate": GRID, "upper_rate": GRID, "shout_rate": GRID,
    "word_length": (40, 30, 25, 20, 18, 16, 15, 14, 13, 12, 11, 10, 9.5, 9),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list) -> int:
    """Words in a window of three that occurs twice or more in the text; each word counts once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times: dict = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered, last = 0, -1
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 2 - max(last, i - 1)
            last = i + 2
    return covered


def measure(text: str | None) -> tuple:
    """The five counts, then the statistics in the order of RULES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    per = max(n, 1)
    upper = sum(map(raw.count, _UPPER))
    letters = upper + sum(map(raw.count, _LOWER))
    return n, chars, symbols, dup, repeats, symbols / per, repeats / per, dup / max(len(lines), 1), upper / max(letters, 1), text.count("!") / per, chars / per


_UPPER = [bytes([b]) for b in range(65, 91)]
_LOWER = [bytes([b]) for b in range(97, 123)]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, the five counts, the statistics) of every row. Null text: all 0; null stratum: ''."""
    names = [*COUNTS, *RULES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = pd.DataFrame([measure(t) for t in part["text"]], columns=names)
            out.insert(0, "stratum", part["stratum"].to_numpy())
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    kinds = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RULES)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return map_pandas(rows, run, f"doc_id long, stratum string, {kinds}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def least_holdouts(risk: float, error: float) -> int:
    """Good holdouts below which no cutoff can pass, even if none is rejected."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, rules: dict[str, tuple[float, ...]] | None = None) -> pd.DataFrame:
    """(stratum, rule, cutoff, good, rejected_good, rejected_bad, p_value) of the certified rules.

    measured: as statistics() gives it. labels: (doc_id, label), 1 for good, an id once. Rows of measured that repeat
    an id are one holdout. risk is split evenly among the rules,
    error among rules and strata. Of the cutoffs that pass, the one that rejects most bad texts is taken, at equal
    counts the loosest; a rule that rejects no bad text is left out. Counts come from an aggregation; only one row
    a rule, stratum and cutoff reaches the driver, and only of strata with enough good holdouts to certify anything.
    """
    rules = rules or RULES
    # an id is one holdout: of rows that repeat it the least one
    names = ["stratum", *rules]
    held = measured.join(labels, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("x")).select("label", "x.*")
    share = risk / len(rules)
    strata = held.where("label = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("good")).where(F.col("good") >= least_holdouts(share, error))
    n_strata = strata.count()
    tried = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > float(c)).alias("out")) for r, cs in rules.items() for c in cs))
    counted = (
        held.select("stratum", "label", F.explode(tried).alias("x")).where("x.out")
        .groupBy("stratum", "x.rule", "x.cutoff").agg(F.count_if(F.col("label") == 1).alias("rejected_good"), F.count_if(F.col("label") == 0).alias("rejected_bad"))
    )
    rows = strata.join(counted, "stratum", "left").toPandas()
    found = []
    for stratum, own in rows.groupby("stratum"):
        good = int(own["good"].iloc[0])
        by = {(r, c): (int(g), int(b)) for r, c, g, b in zip(own["rule"], own["cutoff"], own["rejected_good"].fillna(0), own["rejected_bad"].fillna(0))}
        for rule, cuts in rules.items():
            passed = []
            for cut in cuts:
                g, b = by.get((rule, float(cut)), (0, 0))
                p = binomial_tail(g, good, share)
                if p > error / (len(rules) * n_strata):
                    break
                passed.append((b, float(cut), g, p))
            if passed and (best := max(passed, key=lambda x: (x[0], x[1])))[0]:
                found.append((stratum, rule, best[1], good, best[2], best[0], best[3]))
    return pd.DataFrame(found, columns=["stratum", "rule", "cutoff", "good", "rejected_good", "rejected_bad", "p_value"])


def quality_verdicts(docs: DataFrame, labels: DataFrame, mark: str = "quality", id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(doc_id, stratum, counts, statistics, base_failed, rejected_by, kept) for every row of docs.

    base_failed: under 50 words, or over half of the words in repeated windows. rejected_by: the certified rules of
    the row's stratum that reject it. A stratum with too few good holdouts has no rule and loses nothing. Null or
    empty text: counts 0, base_failed. Null id: judged as any other, never a holdout. Repeated rows: each is
    returned. Other columns are ignored; an empty table gives no rows. Memory: the longest text's words and windows,
    some 300 bytes a word.
    """
    measured = stage(statistics(docs, id_col, text_col, stratum_col), "quality")
    cuts = certified_cutoffs(measured, clean_labels(labels, mark), risk, error)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    spark = docs.sparkSession
    # one row for each certified rule of a stratum that has hundreds of labelled texts
    limits = spark.createDataFrame([(s, dict(zip(own["rule"], map(float, own["cutoff"])))) for s, own in cuts.groupby("stratum")], "stratum string, cutoffs map<string,double>")
    judged = measured.join(limits, "stratum", "left")
    hits = F.filter(F.array(*(F.when(F.col(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    judged = judged.withColumn("base_failed", base).withColumn("rejected_by", hits)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _sql(risk: float = 0.02, error: float = 0.05) -> str:
    """The same in SQL: exact binomial tails from log-gamma, and the fixed sequence as a running conjunction."""
    share, word = risk / len(RULES), r"[^\x20\x09-\x0D]"
    cuts = ", ".join(f"('{r}', {k}, {float(c)}::DOUBLE)" for r, cs in RULES.items() for k, c in enumerate(cs))
    order = ", ".join(f"('{r}', {k})" for k, r in enumerate(RULES))
    each = " UNION ALL ".join(f"SELECT {{own}}, '{r}' AS rule, {r} AS v FROM {{source}}" for r in RULES)
    held = " UNION ALL ".join(f"SELECT x.stratum AS stratum, label, '{r}' AS rule, x.{r} AS v FROM holdout" for r in RULES)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '{word}+') AS w FROM d),
tri AS (SELECT rid, p, [w[p], w[p + 1], w[p + 2]] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
dl AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY rid),
b AS (SELECT d.rid, doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, coalesce(dl.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
 coalesce(dl.n, 0) AS lines, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[a-z]')) AS low, len(regexp_extract_all(t, '!')) AS bang FROM d JOIN w USING (rid) LEFT JOIN cov ON cov.rid = d.rid LEFT JOIN dl ON dl.rid = d.rid),
m AS MATERIALIZED (SELECT *, n_symbols / greatest(n_words, 1) AS symbol_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate, n_dup_lines / greatest(lines, 1) AS dup_line_rate, up / greatest(up + low, 1) AS upper_rate, bang / greatest(n_words, 1) AS shout_rate, word_chars / greatest(n_words, 1) AS word_length FROM b),
lb AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
holdout AS MATERIALIZED (SELECT m.doc_id, label, min({{'stratum': stratum, {', '.join(f"'{r}': {r}" for r in RULES)}}}) AS x FROM m JOIN lb USING (doc_id) GROUP BY m.doc_id, label),
st AS MATERIALIZED (SELECT x.stratum AS stratum, count(*) AS good FROM holdout WHERE label = 1 GROUP BY x.stratum HAVING count(*) >= {least_holdouts(share, error)}),
hv AS ({held}), cut(rule, k, c) AS (VALUES {cuts}), ord(rule, o) AS (VALUES {order}),
cnt AS MATERIALIZED (SELECT st.stratum, st.good, cut.rule, cut.k, cut.c, count(*) FILTER (label = 1 AND v > c) AS g, count(*) FILTER (label = 0 AND v > c) AS bad FROM st JOIN hv USING (stratum) JOIN cut USING (rule) GROUP BY ALL),
tail AS (SELECT stratum, rule, k, c, bad, CASE WHEN g >= good THEN 1.0 ELSE (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({share}) + (good - i) * ln(1 - {share}))) FROM (SELECT unnest(range(g + 1)) AS i)) END AS p FROM cnt),
ok AS (SELECT *, bool_and(p <= {error} / ({len(RULES)} * (SELECT count(*) FROM st))) OVER (PARTITION BY stratum, rule ORDER BY k) AS pass FROM tail),
lim AS MATERIALIZED (SELECT stratum, rule, c FROM ok WHERE pass AND bad > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, c DESC) = 1),
mv AS ({each.format(own="rid, stratum", source="m")}),
hit AS (SELECT rid, string_agg(rule, ',' ORDER BY o) AS rejected_by FROM mv JOIN lim USING (stratum, rule) JOIN ord USING (rule) WHERE v > c GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM m LEFT JOIN hit USING (rid)"""


OP5_SQL = _sql()
