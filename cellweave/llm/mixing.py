"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of source, language and topic. A cell's token weight is its tokens times one factor for
each of its three categories; raking sets the factors in turn until the weights' shares match the targets of every
marginal. A document's probability is its cell's factor, which raking holds at 1 at most, and a document is
taken where a hash of its id falls below it. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named, stage, table

MARGINS = ("source", "lang", "topic")
ROUNDS = 25
#: Cells that are few: they are raked by windows, and their factors are broadcast (some 50 bytes each).
FEW_CELLS = 100_000
#: Topics by form, the first that holds.
TOPICS = (("table", r"\|[^|\n]*\|[^|\n]*\|"), ("notice", r"[Ll]icen[sc]e"), ("contact", r"[a-z0-9]@[a-z0-9]|https?:"), ("figures", r"[0-9]{3}"))


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def _described(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> dict[str, Column]:
    """doc_id, source, lang, topic and tokens as expressions. Null categories become ''; null text has no tokens."""
    text = F.coalesce(named(text_col), F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""))
    plain = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    return {"doc_id": named(id_col).cast("long"), "source": plain(source_col), "lang": plain(lang_col), "topic": topic_of(text), "tokens": words.cast("long")}


def describe(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of each row."""
    return docs.select([value.alias(name) for name, value in _described(**columns).items()])


def tempered_targets(cells: DataFrame, margin: str, temperature: float) -> DataFrame:
    """(margin, target): shares in proportion to tokens to the power of temperature; 0 gives equal shares."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(float(temperature))))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(margin, (F.col("p") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = 1e-10, few: int = FEW_CELLS, keep: float | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with `factor`, so that tokens * factor has the targets' shares.

    Each step divides the weights of one margin's categories by their sum and multiplies them by the target. Up to
    `few` cells a step is a window over the margin, and some rounds are one plan; with more, sums are aggregated,
    partly before the shuffle, and joined back, and each step is written. The results are the same. Categories without
    a target keep no weight. Raking ends after `rounds`, or when a round changes no factor by more than tolerance,
    relatively; shortfall() says what is left between shares and targets then.

    With keep, factors are probabilities: weights sum to keep of all tokens, no factor passes 1, and cells that have
    come to 1 leave the rest of their categories' targets to the other cells. A last step of each round holds the sum
    where a category has too few tokens for its target.
    """
    now = cells.where("tokens > 0").select(*MARGINS, "tokens", F.lit(1.0 if keep is None else float(keep)).alias("factor"), F.lit(0.0).alias("change"))
    for m, t in targets.items():
        now = now.join(t.select(m, F.col("target").alias(f"_{m}")), m, "left")
    now = stage(now.fillna(0.0, [f"_{m}" for m in targets]), "cells")
    n, total = now.agg(F.count(F.lit(1)), F.sum("tokens").cast("double")).first()
    small, mass = n <= few, 1.0 if keep is None else float(keep) * (total or 0.0)

    def step(now: DataFrame, m: str | None) -> DataFrame:
        own = F.sum(F.col("tokens") * F.col("factor"))
        if small:
            now = now.withColumn("_sum", own.over(Window.partitionBy(*([m] if m else []))))
        elif m:
            now = now.join(now.groupBy(m).agg(own.alias("_sum")), m)
        else:
            now = now.join(F.broadcast(now.agg(own.alias("_sum"))))
        ratio = F.when(F.col("_sum") > 0, (F.col(f"_{m}") if m else F.lit(1.0)) * mass / F.col("_sum")).otherwise(0.0)
        new = F.col("factor") * ratio if keep is None else F.least(F.lit(1.0), F.col("factor") * ratio)
        changed = F.when(new > 0, F.abs(new / F.col("factor") - 1)).otherwise(0.0)
        now = now.select(*MARGINS, "tokens", new.alias("factor"), F.greatest("change", changed).alias("change"), *(f"_{x}" for x in targets))
        return now if small else stage(now, "cells")

    done, at_once = 0, 2 if small else 1
    while done < rounds:
        for _ in range(min(at_once, rounds - done)):
            # what the last round changes is what counts
            now = now.withColumn("change", F.lit(0.0))
            for m in (*MARGINS, *([] if keep is None else [None])):
                now = step(now, m)
        done += at_once
        now = stage(now, "cells") if small else now
        if (now.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    return now.select(*MARGINS, "tokens", "factor")


def shortfall(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, category, target, share) of each target: the share of the raked tokens that its category has. They
    differ where `rounds` were too few, or where no weights of the cells can meet all targets at once."""
    total = raked.agg(F.sum(F.col("tokens") * F.col("factor")).alias("total"))
    out = None
    for m in MARGINS:
        sums = raked.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("own"))
        part = targets[m].join(sums, m, "left").join(F.broadcast(total)).select(F.lit(m).alias("margin"), F.col(m).alias("category"), "target", F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)).alias("share"))
        out = part if out is None else out.union(part)
    return out


def draw(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of the MD5 of its decimal text."""
    return F.conv(F.substring(F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _drawn(own: DataFrame, names: dict[str, str], targets: dict[str, DataFrame] | None, temperatures: tuple[float, float, float], keep: float, rounds: int, calibrated: bool) -> tuple[DataFrame, list[str]]:
    """own, a written table, with three more columns, whose names come along: weight, probability, selected.

    names: its columns that hold doc_id, the margins and tokens. A factor meets its cell's rows where they lie.
    """
    cells = stage(own.groupBy([F.col(names[m]).alias(m) for m in MARGINS]).agg(F.sum(names["tokens"]).alias("tokens")), "mix-cells")
    targets = targets or {m: tempered_targets(cells, m, t) for m, t in zip(MARGINS, temperatures)}
    raked = rake(cells, targets, rounds, keep=keep if calibrated else None)
    total, n_cells = raked.agg(F.sum("tokens").cast("double"), F.count(F.lit(1))).first()
    weight, probability, selected, *keys = fresh(own, "weight", "probability", "selected", "key_source", "key_lang", "key_topic")
    factors = raked.select(*(F.col(m).alias(k) for m, k in zip(MARGINS, keys)), (F.col("factor") * (1 / keep if calibrated else total or 0.0)).alias(weight))
    # one row a cell meets the documents; where it is a join, AQE splits the hot cells' documents
    out = own.join(F.broadcast(factors) if n_cells <= FEW_CELLS else factors, [F.col(names[m]) == F.col(k) for m, k in zip(MARGINS, keys)], "left").drop(*keys)
    out = out.withColumn(weight, F.when(F.col(names["tokens"]) > 0, F.coalesce(weight, F.lit(0.0))).otherwise(0.0))
    out = out.withColumn(probability, F.least(F.lit(1.0), F.lit(float(keep)) * F.col(weight)))
    return out.withColumn(selected, draw(names["doc_id"]) < F.col(probability)), [weight, probability, selected]


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperatures: tuple[float, float, float] = (0.7, 0.7, 0.7), keep: float = 0.5, rounds: int = ROUNDS, calibrated: bool = True, **columns: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, selected) for every row of docs.

    targets: for each margin (category, target), shares that sum to 1; by default tempered token shares. keep: the
    expected share of tokens (over 0, up to 1). weight: the cell's factor, 1 where targets equal the shares as they are;
    probability: keep * weight. calibrated: factors are raked with probabilities held at 1, so that the expected tokens
    are keep of all, and have the targets' shares wherever categories have tokens enough for that (else all of theirs,
    and the others share what is left as their targets do); without it probabilities are cut at 1 after raking, and
    cells that are cut fall short. Null categories are the
    category ''; null or empty text has no tokens and weight, probability 0. Each row has its own cell's probability;
    equal ids have one draw, null ones too. Other columns are ignored; an empty table gives no rows. Memory: a text
    and its words.
    """
    own = stage(describe(docs, **columns), "described")
    out, _ = _drawn(own, {c: c for c in own.columns}, targets, temperatures, keep, rounds, calibrated)
    return out.select("doc_id", *MARGINS, "tokens", "weight", "probability", "selected")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperatures: tuple[float, float, float] = (0.7, 0.7, 0.7), keep: float = 0.5, rounds: int = ROUNDS, calibrated: bool = True, **columns: str) -> DataFrame:
    """The rows of docs that mix() selects; columns as they are, whatever their names. No text is exchanged: rows are
    written once with their cell beside them, and filtered as they are read again."""
    given = _described(**columns)
    names = dict(zip(given, fresh(docs, *(f"mix_{name}" for name in given))))
    own = stage(docs.select(*(named(c) for c in docs.columns), *(value.alias(names[name]) for name, value in given.items())), "described")
    out, (*_, selected) = _drawn(own, names, targets, temperatures, keep, rounds, calibrated)
    return out.where(F.col(selected)).select([named(c) for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *MARGINS, "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def _sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: each raking step is one common table expression."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    parts = [
        f"own AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)",
        "r0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens, CAST(0.5 AS DOUBLE) AS factor FROM own GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    half = "(0.5 * (sum(tokens) OVER ())::DOUBLE)"
    for m in MARGINS:
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, power(sum(tokens)::DOUBLE, 0.7) / sum(power(sum(tokens)::DOUBLE, 0.7)) OVER () AS target FROM r0 GROUP BY {m})")
    last = "r0"
    for i in range(rounds):
        for m in MARGINS:
            name = f"r{i}_{m}"
            parts.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(1.0, factor * (target * {half} / sum(tokens * factor) OVER (PARTITION BY {m}))) AS factor FROM {last} JOIN t_{m} USING ({m}))")
            last = name
        parts.append(f"r{i}_all AS MATERIALIZED (SELECT source, lang, topic, tokens, least(1.0, factor * ({half} / sum(tokens * factor) OVER ())) AS factor FROM {last})")
        last = f"r{i}_all"
    parts.append(f"w AS MATERIALIZED (SELECT source, lang, topic, factor * 2 AS weight FROM {last})")
    draw = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, tokens, round(v, 6) AS weight, round(least(1.0, 0.5 * v), 6) AS probability, {draw} < least(1.0, 0.5 * v) AS selected
FROM (SELECT own.*, CASE WHEN tokens > 0 THEN coalesce(weight, 0.0) ELSE 0.0 END AS v FROM own LEFT JOIN w USING (source, lang, topic))"""


OP1_SQL = _sql()
