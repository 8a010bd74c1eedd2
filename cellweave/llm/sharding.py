"""Sharding by histogram sort: shards of nearly equal bytes, contiguous in one order of all documents.

Documents go by a hash of their text, then by a hash of their id. The sort finds where shards end before it moves a row:
bytes are counted exactly below candidate keys, the boundaries of cells of one digit more a round, and only the cells
that still hold a splitter are looked into again, until every splitter meets the tolerance. Then rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, named, stage, table

#: Bits of a text's hash and of an id's hash that make up the order.
KEY, TIE = 60, 56
#: Bits of the key that the first round looks at, and further bits a round.
FIRST, MORE = 12, 8
#: What a splitter may be off, as a share of a shard's bytes, and the share beyond which copies of one text may be parted.
TOLERANCE, GROUP = 0.0025, 0.01


def _hash(text: Column, bits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """size (UTF-8 bytes and 1; null text: 1), text_crc32, and the order's key and tie, as expressions."""
    text = F.coalesce(named(text_col), F.lit(""))
    return {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "key": _hash(text, KEY), "tie": _hash(F.coalesce(named(id_col).cast("string"), F.lit("")), TIE)}


@dataclass(frozen=True)
class Cell:
    """Keys that share their first bits: place is those bits, of `key` up to KEY of them and of `tie` beyond; start is
    the number of bytes below."""

    bits: int
    key: int
    tie: int
    start: int
    size: int
    rows: int
    single: bool  # one key and tie: nothing to look into

    def first(self) -> tuple[int, int]:
        """The least (key, tie) in the cell."""
        k = min(self.bits, KEY)
        return self.key << (KEY - k), self.tie << (TIE - max(0, self.bits - KEY))


def _grid(bits: int, more: int) -> int:
    """The bits of the next round's cells: all of the key before any of the tie."""
    return min(bits + more, KEY) if bits < KEY else min(bits + more, KEY + TIE)


def _inside(rows: DataFrame, cells: list[Cell], more: int) -> dict[tuple, list[Cell]]:
    """For each cell its sub-cells in order, by one aggregation. The cells are at most as many as there are splitters
    and parts, and are broadcast; a cell has at most 2^more sub-cells."""
    spark, out = rows.sparkSession, {}
    for bits in sorted({c.bits for c in cells}):
        held = [c for c in cells if c.bits == bits]
        then = _grid(bits, more)
        at = lambda b: (F.shiftright("key", max(0, KEY - b)), F.shiftright("tie", TIE - (b - KEY)) if b > KEY else F.lit(0).cast("long"))
        own = rows.select(at(bits)[0].alias("k0"), at(bits)[1].alias("t0"), at(then)[0].alias("k1"), at(then)[1].alias("t1"), "key", "tie", "size")
        if bits:
            own = own.join(F.broadcast(spark.createDataFrame([(c.key, c.tie) for c in held], "k0 long, t0 long")), ["k0", "t0"], "left_semi")
        one = (F.min("key") == F.max("key")) & (F.min("tie") == F.max("tie"))
        found = own.groupBy("k0", "t0", "k1", "t1").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), one.alias("single")).collect()
        starts = {(c.key, c.tie): c.start for c in held}
        for r in sorted(found, key=lambda r: (r.k1, r.t1)):
            cell = Cell(then, r.k1, r.t1, starts[r.k0, r.t0], r["size"], r["rows"], r.single)
            starts[r.k0, r.t0] += r["size"]
            out.setdefault((bits, r.k0, r.t0), []).append(cell)
    return out


def splitters(rows: DataFrame, n: int, part_bytes: int, tolerance: float = TOLERANCE, group: float = GROUP) -> tuple[list[Cell], list[int]]:
    """(cells, ends): cells in order that make up all rows, none that can be parted larger than part_bytes, and the
    byte positions of the n - 1 splitters, each the start of a cell or the end of all.

    rows: (key, tie, size). A splitter is the boundary nearest to k / n of all bytes (of two the first) in the first
    round whose nearest is within the tolerance; where the rounds end before that, the nearest of all. Copies of one
    text are parted only where they have more than `group` of a shard's bytes, and rows that share text and id never.
    """
    cells = [c for own in _inside(rows, [Cell(0, 0, 0, 0, 0, 0, False)], FIRST).values() for c in own]
    total = cells[-1].start + cells[-1].size if cells else 0
    ends: dict[int, int] = {}
    while cells:
        bounds = [c.start for c in cells] + [total]
        wanted = {}
        for k in range(1, n):
            if k in ends:
                continue
            place = min(bounds, key=lambda b: (abs(n * b - k * total), b))
            at = bisect_right(bounds, k * total // n) - 1
            cell = cells[min(at, len(cells) - 1)]
            whole = cell.single or (cell.bits == KEY and n * cell.size <= group * total) or cell.bits >= KEY + TIE
            if abs(n * place - k * total) <= tolerance * total or whole:
                ends[k] = place
            else:
                wanted[cell.bits, cell.key, cell.tie] = cell
        for c in cells:
            if c.size > part_bytes and not c.single and c.bits < KEY + TIE:
                wanted[c.bits, c.key, c.tie] = c
        if not wanted:
            break
        inside = _inside(rows, list(wanted.values()), MORE)
        cells = [x for c in cells for x in inside.get((c.bits, c.key, c.tie), [c])]
    return cells, [ends[k] for k in sorted(ends)]


def _parts(cells: list[Cell], ends: list[int], part_bytes: int) -> list[tuple]:
    """(key, tie, shard, part, offset): where each part begins, its number, and how many of its shard's rows are before
    it. A part is neighbouring cells of one shard, of about part_bytes."""
    out, held, offset, before = [], 0, 0, -1
    for c in cells:
        shard = bisect_right(ends, c.start)
        if shard != before:
            offset = 0
        if shard != before or held + c.size > part_bytes:
            out.append((*c.first(), shard, len(out), offset))
            held = 0
        held, offset, before = held + c.size, offset + c.rows, shard
    return out


def shard(docs: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 128 << 20, tolerance: float = TOLERANCE, group: float = GROUP) -> DataFrame:
    """docs with shard (0 to n - 1), slot (0, 1, ... in its shard), size and text_crc32; partitioned and sorted by
    (shard, slot), so that writing by shard is no further exchange.

    Shards have nearly equal bytes (size: UTF-8 bytes and 1), as splitters() says. Equal texts are neighbours. Null texts
    are empty ones; null ids are one id. Rows that share text and id have slots next to each other, in any order. Where
    docs has a column of an added name, that of the added one gets underscores. An empty table stays empty.
    Counting reads texts once, into a table of keys and sizes; the exchange carries each row once. The driver holds
    cells: 2^FIRST, and 2^MORE for each part or splitter that is looked into. A task holds no more than a sort does.
    """
    spark = docs.sparkSession
    made = sizes(docs, id_col, text_col)
    rows = stage(docs.select(*(made[k].alias(k) for k in ("key", "tie", "size"))), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bytes = max(1, min(part_bytes, total // slots + 1))
    cells, ends = splitters(rows, n, part_bytes, tolerance, group)
    parts = _parts(cells, ends, part_bytes)
    names = fresh(docs, "shard", "slot", "size", "text_crc32", "key", "tie", "part", "offset", "begun", "cell")
    s, slot, size, crc, key, tie, part, offset, begun, cell = names
    # a row's part is the last that begins at or before it: of those that begin in its first-round cell, or before that
    by_cell: dict[int, list[tuple]] = {}
    for p in parts:
        by_cell.setdefault(p[0] >> (KEY - FIRST), []).append(p)
    table_rows, last = [], None
    for c in range(1 << FIRST):
        own = by_cell.get(c, [])
        listed = ([last] if last is not None else []) + own
        if listed:
            table_rows.append((c, [(*p,) for p in listed]))
            last = listed[-1]
    lookup = spark.createDataFrame(table_rows, f"{cell} int, {begun} array<struct<key:bigint,tie:bigint,shard:int,part:int,offset:bigint>>")
    keyed = docs.select("*", *(made[k].alias(v) for k, v in (("size", size), ("text_crc32", crc), ("key", key), ("tie", tie))))
    keyed = keyed.withColumn(cell, F.shiftright(key, KEY - FIRST).cast("int")).join(F.broadcast(lookup), cell)
    mine = F.element_at(F.filter(begun, lambda p: (p["key"] < F.col(key)) | ((p["key"] == F.col(key)) & (p["tie"] <= F.col(tie)))), -1)
    keyed = keyed.withColumn(begun, F.when(F.size(begun) == 1, F.col(begun)[0]).otherwise(mine))
    keyed = keyed.select(*(named(c) for c in docs.columns), F.col(f"{begun}.shard").alias(s), F.col(f"{begun}.part").alias(part), F.col(f"{begun}.offset").alias(offset), size, crc, key, tie)
    dealt = keyed.repartitionById(max(1, len(parts)), F.col(part))
    place = F.row_number().over(W.partitionBy(part).orderBy(key, tie, named(id_col)))
    return dealt.withColumn(slot, F.col(offset) + place - 1).select(*(named(c) for c in docs.columns), s, slot, size, crc)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """shard(docs) as Parquet under path/shard=k; each shard's files are in order of their slots. The rows, read back."""
    out = shard(docs, **options)
    out.write.partitionBy([c for c in out.columns if c not in docs.columns][0]).parquet(path)
    return docs.sparkSession.read.parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes; see shard()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of whole texts by folding their bytes over its table, a list that each text is joined with.
OP12_SQL = rf"""
WITH RECURSIVE ct(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM ct WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM ct WHERE k = 8),
d0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
d AS MATERIALIZED (SELECT rid, doc_id, strlen(t)::BIGINT + 1 AS size, CAST(('0x' || substr(md5(t), 1, 15)) AS BIGINT) AS key, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 14)) AS BIGINT) AS tie,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(t)), lambda j: CAST(('0x' || substr(h, 2 * j + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(t)) AS h FROM d0), crc),
total AS (SELECT sum(size)::BIGINT AS total FROM d),
big AS (SELECT key FROM d GROUP BY key HAVING 8 * sum(size) > {GROUP} * (SELECT total FROM total)),
lv AS (SELECT unnest([{", ".join(map(str, [*range(FIRST, KEY, MORE), KEY]))}]) AS bits),
cells AS (SELECT bits, key >> ({KEY} - bits) AS k, 0::BIGINT AS t, sum(size) AS size FROM d, lv GROUP BY ALL UNION ALL
  SELECT {KEY} + bits, d.key, CASE WHEN big.key IS NULL THEN 0 ELSE tie >> ({TIE} - bits) END, sum(size) FROM d LEFT JOIN big ON big.key = d.key, (SELECT unnest([{", ".join(map(str, range(MORE, TIE + 1, MORE)))}]) AS bits) GROUP BY ALL),
bounds AS (SELECT bits, coalesce(sum(size) OVER (PARTITION BY bits ORDER BY k, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM cells UNION ALL SELECT DISTINCT bits, total FROM cells, total),
near AS (SELECT k, bits, b, abs(8 * b - k * total) AS off FROM bounds, total, (SELECT unnest(range(1, 8)) AS k) QUALIFY row_number() OVER (PARTITION BY k, bits ORDER BY abs(8 * b - k * total), b) = 1),
ends AS (SELECT k, b FROM near, total QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN off <= {TOLERANCE} * total THEN bits ELSE 1000 - bits END) = 1),
pos AS (SELECT key, tie, coalesce(sum(s) OVER (ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM (SELECT key, tie, sum(size) AS s FROM d GROUP BY ALL)),
placed AS (SELECT key, tie, (SELECT count(*) FROM ends WHERE ends.b <= pos.p) AS shard FROM pos)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, tie, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN placed USING (key, tie)
"""
