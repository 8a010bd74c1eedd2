"""Line deduplication by overlapping windows of consecutive lines.

Every window of three consecutive lines is hashed; a window whose lines occur anywhere before, in the order of
(doc_id, line), is a repeat, and the lines that any repeat covers go. Windows are judged on the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, stage, table

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, pos, h1, h2) for each window: two hashes, of 64 and 32 bits, of the lines' hashes in order.

    Windows without a visible character are left out, and so are rows with a null id or text.
    """
    rows = docs.where(named(id_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).cast("long").alias("doc_id"), F.split(named(text_col), "\n", -1).alias("lines")).where(F.size("lines") >= width)
    hashed = rows.select("doc_id", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x, F.length(x)).alias("b"), (F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "").alias("seen"))).alias("h"))
    each = hashed.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - width), lambda i: F.slice("h", i + 1, width))).alias("pos", "w")).where(F.exists("w", lambda x: x["seen"]))
    parts = [F.col("w")[i] for i in range(width)]
    return each.select("doc_id", "pos", F.xxhash64(*(p["a"] for p in parts)).alias("h1"), F.hash(*(p["b"] for p in parts)).alias("h2"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, starts): for each document with repeats, the lines at which windows start that occur before.

    Windows meet by hash: firsts are aggregated before the shuffle, and the join back is one that AQE can split
    where a window is hot.
    """
    windows = stage(line_windows(docs, id_col, text_col, width), "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where("doc_id <> first.doc_id or pos <> first.pos")
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, list[str]]:
    """docs with two more columns, whose names come along: the numbers of the lines that stay, and the text that they
    make; the first is null where all stay."""
    own, starts, lines, kept, text = fresh(docs, "own", "starts", "lines", "kept", "kept_text")
    found = repeats(docs, id_col, text_col, width).select(F.col("doc_id").alias(own), F.col("starts").alias(starts))
    rows = docs.join(found, named(id_col).cast("long") == F.col(own), "left")
    # a column of its own: inside transform() a text would be split again for each of its lines
    rows = rows.withColumn(lines, F.when(F.col(starts).isNotNull() & named(text_col).isNotNull(), F.split(named(text_col), "\n", -1)))
    covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1)))
    rows = rows.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    texts = F.array_join(F.transform(kept, lambda i: F.col(lines)[i]), "\n")
    return rows.withColumn(text, F.when(F.col(kept).isNull(), named(text_col)).otherwise(texts)), [kept, text]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, n_chars_col: str | None = None) -> DataFrame:
    """All rows and columns of docs, with text_col shortened; n_chars_col, if given, follows it where it is shortened.

    Only repeats travel to the texts. Lines are what stands between newlines; kept lines are joined by newlines again.
    Fewer lines than a window, or empty text: unchanged. Null text: stays null. Null id: unchanged, and no source of
    repeats. Rows that repeat an id are each judged as that id: equal windows at one (doc_id, line) are one
    occurrence. Other columns stay as they are, whatever their names. An empty table gives no rows. Memory: a text and
    its lines.
    """
    rows, (kept, text) = _judged(docs, id_col, text_col, width)
    out = []
    for c, kind in docs.dtypes:
        value = named(c)
        if c == text_col:
            value = F.col(text).alias(c)
        elif c == n_chars_col:
            value = F.when(F.col(kept).isNotNull(), F.char_length(text).cast(kind)).otherwise(value).alias(c)
        out.append(value)
    return rows.select(out)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row: dedup_lines() with counts of lines; a null text has none."""
    rows, (kept, text) = _judged(docs, id_col, text_col, width)
    old = named(text_col)
    n_lines = F.when(old.isNull(), 0).otherwise(F.length(old) - F.length(F.replace(old, F.lit("\n"))) + 1).cast("long")
    removed = F.when(F.col(kept).isNull(), 0).otherwise(n_lines - F.size(kept)).cast("long")
    return rows.select(named(id_col).alias("doc_id"), n_lines.alias("n_lines"), removed.alias("n_removed"), F.col(text).alias("text"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), pos AS (
  SELECT doc_id, l, unnest(range(len(l) - 2)) AS p FROM lines WHERE len(l) >= 3
), w AS (
  SELECT doc_id, p, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c FROM pos
), seen AS (
  SELECT * FROM w WHERE regexp_matches(a || b || c, '[^ \t\r\x0b\x0c]')
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM seen
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1
), each AS (
  SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS line FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS text,
         count(g.p) AS n_removed, count(*) AS n_lines
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
