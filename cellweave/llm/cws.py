"""Document fingerprints by consistent weighted sampling: equal places are as likely as texts are alike.

A text is its words with their counts as weights. For each of K places every term draws r and c from Gamma(2, 1) and
b from the unit interval, always the same draws for the same term; a term of weight w has t = floor(ln w / r + b),
and the term with the least ln c - r (t - b + 1) is the sample. Two texts have the same (term, t) at a place with
probability sum(min) / sum(max) of their weights, their generalised Jaccard similarity.

All of it is DataFrame functions. Draws are tabulated: a term's hash picks one row of a table with r and b for all
places and one of a table with c, two tables of fixed size, so that a sample costs a few arithmetic operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import named, table

PLACES = 64
#: Rows of each table of draws; the tables' size (POOL * PLACES * 24 bytes) is fixed, so they are broadcast.
POOL = 4096
#: Ids that reach the driver to bound ranges of ids: so many at most, and so many a range.
_MARKS, _MARKS_IN_RANGE = 1 << 18, 8
#: Ids that are split because of their many rows: at most so many, as each has more than this fraction of the rows.
_HOT = 1 << 13
_LAST = (1 << 63) - 1


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def draws(spark: SparkSession, places: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """(row, r, inverse, b) and (row, c): for each row an array over the places; c as its logarithm."""
    places_of = F.sequence(F.lit(0), F.lit(places - 1))
    gamma = lambda i, name: -F.log(uniform(F.col("id"), i, F.lit(name)) * uniform(F.col("id"), i, F.lit(name + "'")))
    base = spark.range(0, POOL, 1, 1)
    rb = base.select(F.col("id").alias("row_a"), F.transform(places_of, lambda i: gamma(i, "r")).alias("r"), F.transform(places_of, lambda i: uniform(F.col("id"), i, F.lit("b"))).alias("b"))
    rb = rb.withColumn("inverse", F.transform("r", lambda x: 1 / x))
    return rb, base.select(F.col("id").alias("row_c"), F.transform(places_of, lambda i: F.log(gamma(i, "c"))).alias("c"))


def weighted_terms(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, term, weight: a row for each distinct word of a text, as a hash, with its count. A text without words
    has one row with a null term. Words are parted by \\x20 and \\x09-\\x0D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    sorted_ = rows.select(*keep, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("_h"))
    last = sorted_.withColumn("_e", F.filter(F.sequence(F.lit(1), F.greatest(F.size("_h"), F.lit(1))), lambda i: (i == F.size("_h")) | (F.get("_h", i - 1) != F.get("_h", i))))
    each = last.select(*keep, "_h", "_e", F.posexplode_outer("_e").alias("_j", "_i"))
    return each.select(*keep, F.get("_h", F.col("_i") - 1).alias("term"), (F.col("_i") - F.coalesce(F.get("_e", F.col("_j") - 1), F.lit(0))).alias("weight"))


def samples(terms: DataFrame, *keys: str, places: int = PLACES) -> DataFrame:
    """keys and s0, s1, ...: for each group of terms its sample at each place, as one long.

    The long holds the sampled value, scaled, above bits of the term's hash; so the least long is the sample, and equal
    longs are equal samples. Groups are aggregated where they lie. No terms: all places hold the greatest long.
    """
    rb, c = draws(terms.sparkSession, places)
    known = terms.withColumn("_w", F.log(F.col("weight").cast("double"))).withColumn("row_a", F.col("term").bitwiseAND(F.lit(POOL - 1))).withColumn("row_c", F.shiftrightunsigned("term", 40).bitwiseAND(F.lit(POOL - 1)))
    joined = known.join(F.broadcast(rb), "row_a", "left").join(F.broadcast(c), "row_c", "left").withColumn("_id", F.shiftrightunsigned("term", 8).bitwiseAND(F.lit((1 << 23) - 1)))

    def packed(k: int) -> Column:
        b = F.get("b", F.lit(k))
        t = F.floor(F.col("_w") * F.get("inverse", F.lit(k)) + b)
        value = F.get("c", F.lit(k)) - F.get("r", F.lit(k)) * (t - b + 1.0)
        return F.shiftleft(((value + 128.0) * float(1 << 32)).cast("long"), 23).bitwiseOR(F.col("_id"))

    return joined.groupBy(*keys).agg(*(F.coalesce(F.min(packed(k)), F.lit((1 << 63) - 1)).alias(f"s{k}") for k in range(places)))


def likeness(a: Column, b: Column, places: int = PLACES) -> Column:
    """Share of places at which two arrays of samples agree."""
    total = F.lit(0)
    for k in range(places):
        total = total + F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), 1).otherwise(0)
    return total / float(places)


def _ends_below(ends: list[tuple[int, int | None]], key: Column, part: Column) -> Column:
    """How many of the ends (id, part), in ascending order, lie below (key, part); an end without a part holds its id
    as a whole. A binary search."""
    if not ends:
        return F.lit(0)
    of = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    ids, whole = of(e for e, _ in ends), F.struct(F.lit(0).alias("low"), F.lit(len(ends)).alias("high"))
    split = any(g is not None for _, g in ends)
    parts = of(_LAST if g is None else g for _, g in ends) if split else None

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["low"] + at["high"], 1)
        right = F.get(ids, mid) < key
        if split:
            right = right | ((F.get(ids, mid) == key) & (F.get(parts, mid) < part))
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(F.when(right, mid + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(mid).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length())), whole, halve, lambda at: at["low"])


def text_part(text: str) -> Column:
    """Where a row stands among those of an id with too many rows for one range: by the hash of its text."""
    return F.xxhash64(F.coalesce(named(text), F.lit("")))


def id_ranges(docs: DataFrame, id_col: str, rows_in_range: int = 1_000, text_col: str = "text") -> tuple[Column, DataFrame]:
    """An expression for the number of a row's range of ids, in ascending order, and (head, part, none, into): for each
    range the largest id of the next lower one, which that range needs too (the lowest range needs the largest of
    all; none: it is null).

    Ranges end at ids that are there, chosen by their hash, so that they follow the rows, however the ids are spread:
    of the ids that are chosen, _MARKS at most, every _MARKS_IN_RANGEth ends a range. Null ids come lowest.

    An id, or null, that has rows for several ranges is split by text_part(), descending ids going with descending
    parts; heads inside it have a part. Such ids are at most _HOT, as each has so large a share of the rows. Texts are
    read only of them. Their equal texts stay together. docs without text_col: no id is split.
    """
    spark, key = docs.sparkSession, named(id_col).cast("long")
    high, n_rows = docs.agg(F.max(key), F.count(F.lit(1))).first()
    one_in = max(1, rows_in_range // _MARKS_IN_RANGE, n_rows // _MARKS)
    ends: list[tuple[int | None, int | None]] = []
    top = None
    if n_rows > rows_in_range:
        per_id = docs.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"))
        hot = [r.id for r in per_id.where(F.col("n") > max(2 * rows_in_range, n_rows // _HOT)).collect()] if text_col in docs.columns else []
        marks = docs.select(key.alias("id")).where("id is not null").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(one_in)) == 0).distinct()
        ends += [(e, None) for e in sorted({r.id for r in marks.collect()} - set(hot))[_MARKS_IN_RANGE - 1 :: _MARKS_IN_RANGE]]
        if hot:
            own = docs.select(key.alias("id"), text_part(text_col).alias("part"))
            own = own.join(F.broadcast(spark.createDataFrame([(x,) for x in hot], "hot long")), F.col("id").eqNullSafe(F.col("hot")))
            chosen: dict[int | None, list[int]] = {}
            for r in own.where(F.pmod(F.xxhash64("part", F.lit(5)), F.lit(one_in)) == 0).select("id", "part").distinct().collect():
                chosen.setdefault(r.id, []).append(r.part)
            ends += [(x, g) for x, parts in chosen.items() for g in sorted(parts)[_MARKS_IN_RANGE - 1 :: _MARKS_IN_RANGE]]
            if any(x == high for x, _ in ends):
                top = own.where(F.col("id").eqNullSafe(F.lit(high).cast("long"))).agg(F.max("part")).first()[0]
    # each head goes to one range
    ends = sorted((e for e in set(ends) if e != (high, top)), key=lambda e: (e[0] is not None, e[0] or 0, e[1] or 0))
    heads = spark.createDataFrame([*((e, g, e is None, i + 1) for i, (e, g) in enumerate(ends)), (high, top, high is None, 0)], "head long, part long, none boolean, into int")
    if not ends:
        return F.lit(0), heads
    null_ends, own_ends = [(0, g) for e, g in ends if e is None], [e for e in ends if e[0] is not None]
    part = text_part(text_col) if any(g is not None for _, g in ends) else F.lit(_LAST)
    return F.when(key.isNull(), _ends_below(null_ends, F.lit(0).cast("long"), part)).otherwise(len(null_ends) + _ends_below(own_ends, key, part)), heads


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, samples), a row each.

    edited: the last third of a text (rounded down) replaced by as many first characters, or all, of the next document
    in descending order of ids, the first one after the last. Texts travel once, to ranges of ids. samples: the
    hashes of the samples, of which the fingerprint is made. Null or empty text: no terms, so all such are alike (1).
    Any long is an id; null ids come last; rows that repeat an id are ordered by text, those of an id with rows for
    several ranges, null as well, by the text's hash downwards first, which parts them. A single row is its own next.
    Other columns are ignored; an empty table gives no rows. Memory: a text and its words; ranges spill. Rows that
    share both id and text are of one range.
    """
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    number, heads = id_ranges(docs, "doc_id")
    rows = docs.withColumns({"null_id": F.col("doc_id").isNull(), "range": number})
    # one row a range; ranges are at most _MARKS / _MARKS_IN_RANGE, and as many for the ids that are split
    split = heads.where("part is not null").select(F.col("head").alias("split_id"), F.col("none").alias("split_none")).distinct()
    rows = rows.join(F.broadcast(split), (F.col("null_id") == F.col("split_none")) & F.col("doc_id").eqNullSafe(F.col("split_id")), "left")
    rows = rows.withColumn("own_part", F.when(F.col("split_none").isNotNull(), text_part("text")))
    at_head = (F.col("null_id") == F.col("none")) & F.col("doc_id").eqNullSafe(F.col("head")) & F.col("own_part").eqNullSafe(F.col("part"))
    rows = rows.join(F.broadcast(heads), at_head, "left")
    both = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("range"), F.lit(True).alias("extra")))))
    rows = rows.select("doc_id", "own_part", "text", F.explode(both).alias("x")).select("doc_id", "own_part", "text", "x.range", "x.extra")
    order = W.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("own_part"), "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - CAST(char_length(text) DIV 3 AS INT))"), F.expr("substring(coalesce(next, ''), 1, CAST(char_length(text) DIV 3 AS INT))")))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    keys = ("range", "at", "extra", "doc_id", "n_chars", "edited_sha256", "kind")
    texts = rows.select("range", "at", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(kinds).alias("x")).select(*keys[:-1], "x.kind", "x.t")
    found = samples(weighted_terms(texts, "t", *keys), *keys, places=places)
    found = found.select(*keys, F.array(*(F.col(f"s{k}") for k in range(places))).alias("s"))
    pair = found.groupBy(*keys[:-1]).agg(*(F.max(F.when(F.col("kind") == k, F.col("s"))).alias(f"s{k}") for k in (0, 1)))
    # a sample's hash is what the fingerprint shows and what likeness compares
    pair = pair.withColumns({c: F.transform(c, lambda x: F.hash(x)) for c in ("s0", "s1")})
    pair = pair.withColumn("next", F.lead("s0").over(W.partitionBy("range").orderBy("at"))).where(~F.col("extra"))
    name = lambda col: F.array_join(F.transform(col, lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)))), "")
    return pair.select("doc_id", "n_chars", "edited_sha256", name("s0").alias("fingerprint"), name("s1").alias("edited_fingerprint"), likeness(F.col("s0"), F.col("s1"), places).alias("near_edited"), likeness(F.col("s0"), F.col("next"), places).alias("near_next"), F.col("s0").alias("samples"))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).drop("samples")
