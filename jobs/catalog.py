"""The jobs as queries: each runs twice into one new folder of the shared one and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cellweave.plans.staging import shared_dir

from . import dialogue_chain, event_jumps


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"


def job1_event_jumps(spark, sf_dir: str) -> DataFrame:
    """The second run finds no new file and changes nothing."""
    out = _folder(spark, "job1")
    event_jumps.run(spark, f"{sf_dir}/events.parquet", out)
    return event_jumps.run(spark, f"{sf_dir}/events.parquet", out).select("day", "src", "dst", "n", "us")


def job2_dialogue_chain(spark, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    dialogue_chain.run(spark, f"{sf_dir}/conversations.parquet", out)
    return dialogue_chain.run(spark, f"{sf_dir}/conversations.parquet", out)


QUERIES = {"job1_event_jumps": job1_event_jumps, "job2_dialogue_chain": job2_dialogue_chain}
ORACLES = {
    "job1_event_jumps": """
WITH e AS (SELECT user_id, event_id, event_type, ts, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
p AS (SELECT CAST(ts AS DATE) AS day, event_type AS dst, us, lag(event_type) OVER w AS src, lag(us) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id, event_type))
SELECT day, src, dst, count(*) AS n, CAST(sum(us - before) AS BIGINT) AS us FROM p WHERE src IS NOT NULL GROUP BY day, src, dst""",
    "job2_dialogue_chain": """
WITH RECURSIVE t AS (SELECT conv_id, turn, rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, coalesce(role, 'none') AS role FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, role || CASE WHEN bare = '' THEN '-' WHEN right(bare, 1) = '?' THEN '?' ELSE '.' END AS state FROM t),
w AS (SELECT conv_id, state, lead(state) OVER o AS next, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, state)),
j AS (SELECT 'start' AS src, state AS dst FROM w WHERE k = 1 UNION ALL SELECT state, coalesce(next, CASE WHEN starts_with(state, 'assistant') THEN 'end:answered' ELSE 'end:open' END) FROM w),
n AS (SELECT src, dst, count(*) AS n FROM j GROUP BY ALL),
p AS MATERIALIZED (SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS p FROM n),
mass(k, origin, node, m) AS (SELECT 0, src, src, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM p) UNION ALL
  SELECT mass.k + 1, origin, p.dst, sum(m * p.p) FROM mass JOIN p ON p.src = mass.node WHERE k < 600 AND m > 1e-15 GROUP BY ALL),
a AS (SELECT origin, sum(m) AS answered FROM mass WHERE node = 'end:answered' GROUP BY origin)
SELECT p.src, dst, n, round(p, 6) AS p, round(coalesce(answered, 0.0), 6) AS answered FROM p LEFT JOIN a ON a.origin = p.src""",
}
