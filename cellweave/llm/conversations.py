"""Conversation structure repair: cheapest edits that make roles alternate, solved once for each shared prefix.

What a repair costs depends only on a conversation's signature, one symbol a row for its role and fault. Signatures are
deduplicated, sorted and dealt out by range; walking a sorted run is walking a prefix trie, so that a layer of the
dynamic program is computed once for all signatures below its node, and each terminal node yields an answer.
Conversations pass through sorted streams, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, named, stage, table

SPACES = " \t\n\x0b\x0c\r"
#: What an edit costs, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The roles in order, s?(ua)+ or nothing: 0 at the start, 1 after s, 2 after u, 3 after a.
GO = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
#: From each state (inserts, state after them), as few as lead there.
INSERTS = {0: ((0, 0), (1, 2), (2, 3)), 1: ((0, 1), (1, 2), (2, 3)), 2: ((0, 2), (1, 3)), 3: ((0, 3), (1, 2))}


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, live): rows with faults, by the crc32 of `conv_id:turn` modulo 20 (null: one
    space): 0 drops a row (live is false), 1 empties its text, 2 takes its `[.!?]` out, 3 repeats it, 4 makes its role
    user. Null roles and texts become one space. Other columns are not kept."""
    one = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col)).cast("binary")) % 20
    rows = turns.select(
        named(conv_col).alias("conv_id"), named(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(one(role_col)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one(text_col), "[.!?]", "")).otherwise(one(text_col)).alias("text"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"), (kind != 0).alias("live"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"), "live")


def _plain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live_col: str | None = None) -> DataFrame:
    one = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    live = F.lit(True) if live_col is None else named(live_col)
    return turns.select(named(conv_col).alias("conv_id"), named(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), live.alias("live"))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, fault, live), each conversation together and in order: one exchange, then sorts.

    fault: b blank, d duplicate, t truncated, or nothing; the first that holds.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.select("*", F.md5("text").alias("digest")).repartition("conv_id")
    earlier = F.row_number().over(_window("conv_id", "live", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(bare == "", "b").when(earlier, "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    rows = rows.select("*", fault.alias("fault")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", "turn", F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"), "fault", "live")


def _window(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


_LONGEST = (1 << 63) - 1
_NONE = object()


def _report(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its rows in order; of one conversation a byte a row is held."""
    conv, out = _NONE, []
    first = last = None
    n = turns = illegal = 0
    counts = {"b": 0, "d": 0, "t": 0}
    signature, before = bytearray(), ""

    def row():
        gaps = 0 if first is None else min(last - first + 1 - turns, _LONGEST)
        return (conv, gaps, counts["b"], counts["d"], counts["t"], illegal, signature.decode())

    for batch in batches:
        for c, turn, initial, fault, live in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if conv is _NONE or c != conv:
                if conv is not _NONE:
                    out.append(row())
                conv, first, last, turns, illegal, before = c, None, None, 0, 0, ""
                counts, signature = {"b": 0, "d": 0, "t": 0}, bytearray()
            if not live:
                continue
            if turn is not None and (first is None or turn != last):
                first = turn if first is None else first
                last = turn
                turns += 1
            if before and before + initial not in ("su", "ua", "au"):
                illegal += 1
            before = initial
            if fault:
                counts[fault] += 1
            symbol = "x" if fault in ("b", "d") else initial if initial in "sua" else "o"
            signature += (symbol.upper() if fault == "t" else symbol).encode()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if conv is not _NONE:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema)], schema=schema)


def next_layer(layer: dict, symbol: str) -> dict:
    """{state: (cost, rank, state before, letters)} after one more row.

    Of each state the cheapest way is kept, of several the one with the ASCII-least letters. The ways to one layer all
    end in the letter of its last row and have as many such letters, so none is the start of another, and comparing
    them is comparing the rank of where they come from, then their own letters.
    """
    ways: dict = {}
    more = TRUNCATED if symbol.isupper() else 0
    initial = symbol.lower()

    def offer(state, cost, rank, before, letters):
        way = (cost, rank, letters, before)
        if state not in ways or way < ways[state]:
            ways[state] = way

    for before, (cost, rank, _, _) in layer.items():
        for k, at in INSERTS[before]:
            spent, letters = cost + INSERT * k, "I" * k
            offer(at, spent + DELETE, rank, before, letters + "D")
            if symbol != "x":
                for role, then in GO[at].items():
                    if role == initial:
                        offer(then, spent + more, rank, before, letters + "K")
                    if role != "s":
                        offer(then, spent + REROLE + more, rank, before, letters + "R")
    order = sorted(ways, key=lambda s: ways[s][1:3])
    return {s: (ways[s][0], r, ways[s][3], ways[s][2]) for r, s in enumerate(order)}


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, letters) of sorted signatures. The layers of the current path in the trie are held; a
    signature keeps those of the prefix it shares with the one before."""
    layers, path = [{0: (0, 0, None, "")}], ""
    for signature in signatures:
        shared, most = 0, min(len(path), len(signature))
        while shared < most and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for symbol in signature[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        path = signature
        ends = [(cost + INSERT * k, rank, "I" * k, s) for s, (cost, rank, _, _) in layers[-1].items() for k, at in INSERTS[s] if at in ENDS]
        cost, _, tail, state = min(ends)
        letters = [tail]
        for layer in reversed(layers[1:]):
            _, _, before, own = layer[state]
            letters.append(own)
            state = before
        yield signature, cost, "".join(reversed(letters))


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, sorted and dealt out by range."""
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in solve(x for b in batches for x in b.column(0).to_pylist()):
            rows.append(row)
            size += len(row[0])
            if size > 1 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(signatures.repartitionByRange(parts, "signature").sortWithinPartitions("signature"), run, "signature string, cost long, audit string")


def audits(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation, staged.

    columns: conv_col, turn_col, role_col, text_col, and live_col for a boolean column that is false for rows that are
    not there (their conversation is listed even so). Rows go by turn, nulls first; ties by role, then text. A null
    conv_id is one conversation. Null roles and texts are one space, which is no legal role; nor is an empty one.
    gaps stops at 2^63 - 1. An empty table gives no rows. Of a conversation one byte a row is held by a task, of a
    signature some 300 bytes a row while it is solved; texts, however long, stay in Spark.
    """
    rows = _symbols(_plain(turns, **columns))
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    arrow = _arrow(rows.select("conv_id"), [(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())])
    found = stage(map_arrow(rows, lambda batches: _report(batches, arrow), schema), "signatures")
    # a signature that many conversations have is one row here; AQE splits it where the answers are joined back
    answers = solved(found.select("signature").distinct())
    return stage(found.join(answers, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "audits")


def _arrow(like: DataFrame, more: list[tuple]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(like.schema), *(pa.field(*x) for x in more)])


def repaired(turns: DataFrame, found: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, seq, edit, role, text): the conversations as their audits repair them, each together and in order.

    seq counts from 0; edit is K for rows that were kept, R for those with another role, I for those put in, whose text
    is empty. found: audits() of the same rows. Conversations without rows, or of which nothing is left, have none. A
    conversation is one task's stream; its audit and one batch of rows are held.
    """
    rows = _plain(turns, **columns).where("live")
    text = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    heads = found.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(""), F.col("audit"))
    stream = heads.toDF(*text.columns).union(text).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")
    stream = stream.select("conv_id", "kind", "role", "text")
    arrow = _arrow(stream.select("conv_id"), [("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, seq = None, "", 0, 0, 0

        def inserts():
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                role = "assistant" if state == 2 else "user"
                yield conv, seq, "I", role, ""
                state = GO[state][role[0]]
                at, seq = at + 1, seq + 1

        def edits(batch):
            nonlocal conv, audit, at, state, seq
            for c, kind, role, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not kind:
                    yield from inserts()
                    conv, audit, at, state, seq = c, body, 0, 0, 0
                    continue
                yield from inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = role if edit == "K" else "assistant" if state == 2 else "user"
                    yield conv, seq, edit, role, body
                    state = GO[state][role[0]]
                    seq += 1

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            if out := list(edits(batch)):
                yield packed(out)
        if out := list(inserts()):
            yield packed(out)

    kind = dict(stream.dtypes)["conv_id"]
    return map_arrow(stream, run, f"conv_id {kind}, seq long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256): the hash of `role:text` lines, from repaired() rows as that leaves them."""
    arrow = _arrow(rows.select("conv_id"), [("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = _NONE, None
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv is _NONE or c != conv:
                    if conv is not _NONE:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
        if conv is not _NONE:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow[0].type), pa.array([h.hexdigest()])], schema=arrow)

    return map_arrow(rows.select("conv_id", "role", "text"), run, f"conv_id {dict(rows.dtypes)['conv_id']}, sha256 string")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule, then repaired: (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256). See audits() for nulls and ties."""
    broken = damage(table(spark, sf_dir, "conversations"))
    found = audits(broken, live_col="live")
    hashes = digests(repaired(broken, found, live_col="live"))
    own = fresh(found, "conv")[0]
    hashes = hashes.withColumnRenamed("conv_id", own)
    joined = found.join(hashes, found["conv_id"].eqNullSafe(F.col(own)), "left").drop(own)
    empty = hashlib.sha256().hexdigest()
    return joined.select(*found.columns, F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def _add(way: str, cost: int | str, letters: str) -> str:
    """SQL: a way, which is nine digits of cost and its letters, with more of both."""
    return f"lpad(CAST(CAST(substr({way}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letters}'"


def _closure(prefix: str) -> str:
    v = [f"{prefix}.v{q}" for q in range(4)]
    w2 = f"least({v[2]}, {_add(v[0], 3, 'I')}, {_add(v[1], 3, 'I')}, {_add(v[3], 3, 'I')})"
    w3 = f"least({v[3]}, {_add(v[2], 3, 'I')}, {_add(v[0], 6, 'II')}, {_add(v[1], 6, 'II')})"
    return f"{v[0]} AS w0, {v[1]} AS w1, {w2} AS w2, {w3} AS w3"


def _step(initial: str, sources: tuple[int, ...]) -> str:
    keep = ", ".join(f"CASE WHEN sym = '{initial}' THEN {_add(f'w{q}', 'more', 'K')} END" for q in sources)
    move = "" if initial == "s" else ", " + ", ".join(f"CASE WHEN sym <> 'x' THEN {_add(f'w{q}', '3 + more', 'R')} END" for q in sources)
    return keep + move


OP11_SQL = rf"""
WITH RECURSIVE ct(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM ct WHERE k < 8
), crc AS MATERIALIZED (SELECT i, c FROM ct WHERE k = 8),
d AS MATERIALIZED (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name,
  conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
cr(name, pos, c) AS (
  SELECT DISTINCT name, 1, 4294967295::BIGINT FROM d UNION ALL
  SELECT name, pos + 1, xor(cr.c >> 8, crc.c) FROM cr JOIN crc ON crc.i = xor(cr.c & 255, ord(substr(name, pos, 1))) WHERE pos <= length(name)
), act AS MATERIALIZED (SELECT name, xor(c, 4294967295) % 20 AS act FROM cr WHERE pos = length(name) + 1),
b AS (SELECT conv, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN act = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d JOIN act USING (name) WHERE act <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS initial FROM b),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM o),
s AS MATERIALIZED (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS sym, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM f),
t AS (SELECT conv, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM s GROUP BY conv),
dp(conv, i, v0, v1, v2, v3) AS (
  SELECT conv, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM t UNION ALL
  SELECT conv, i, {_add("w0", 4, "D")}, least({_add("w1", 4, "D")}, {_step("s", (0,))}), least({_add("w2", 4, "D")}, {_step("u", (0, 1, 3))}), least({_add("w3", 4, "D")}, {_step("a", (2,))})
  FROM (SELECT s.conv, s.i, s.sym, s.more, {_closure("dp")} FROM dp JOIN s ON s.conv = dp.conv AND s.i = dp.i + 1)
),
z AS MATERIALIZED (SELECT conv, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM (SELECT conv, least(w0, w3) AS best FROM (SELECT dp.conv, {_closure("dp")} FROM dp JOIN t ON t.conv = dp.conv AND t.n = dp.i))),
l AS (SELECT conv, p, substr(audit, p, 1) AS letter FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS p FROM z)),
e AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv ORDER BY p) AS k FROM l),
g AS (SELECT e.conv, e.p, e.letter, e.k, s.role, s.text, bool_or(e.k = 1 AND e.letter = 'K' AND s.initial = 's') OVER (PARTITION BY e.conv) AS headed FROM e LEFT JOIN s ON s.conv = e.conv AND s.i = e.i AND e.letter <> 'I' WHERE e.letter <> 'D'),
r AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k % 2 = 1) <> headed THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM g GROUP BY conv)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM d) LEFT JOIN t USING (conv) LEFT JOIN z USING (conv) LEFT JOIN r USING (conv)
"""
