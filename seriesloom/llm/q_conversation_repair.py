"""Query of the repair of conversations, with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.conversation_repair import audit_conversations


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by the crc32 of conversation and turn; dropped ones are not ``present``."""
    def known(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


#: crc32 bit by bit; the cheapest edits by a recursion over the rows, four states each.
REPAIR = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS kind FROM src),
rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM rows_),
faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faults),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
pads AS (SELECT * FROM (VALUES ('', 0, '', '', ''), ('', 1, 'I', 'u', 'user:'), ('', 2, 'II', 'a', 'user:' || chr(10) || 'assistant:'),
    ('s', 0, '', 's', ''), ('s', 1, 'I', 'u', 'user:'), ('s', 2, 'II', 'a', 'user:' || chr(10) || 'assistant:'),
    ('u', 0, '', 'u', ''), ('u', 1, 'I', 'a', 'assistant:'), ('u', 2, 'II', 'u', 'assistant:' || chr(10) || 'user:'),
    ('a', 0, '', 'a', ''), ('a', 1, 'I', 'u', 'user:'), ('a', 2, 'II', 'a', 'user:' || chr(10) || 'assistant:')) p (state, k, edits, after, lines)),
best AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS body FROM counts
  UNION ALL
  SELECT conv_id, i, to_, cost, audit, body FROM (
    SELECT b.conv_id, f.i, e.to_, b.cost + 2 * p.k + e.cost AS cost, b.audit || p.edits || e.edit AS audit,
      b.body || CASE WHEN p.lines = '' THEN '' ELSE p.lines || chr(10) END || e.line AS body
    FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN pads p ON p.state = b.state,
    LATERAL (SELECT 'D' AS edit, p.after AS to_, 3 AS cost, '' AS line
      UNION ALL SELECT 'K', f.initial, CASE f.fault WHEN 't' THEN 1 ELSE 0 END, f.role || ':' || f.text || chr(10)
        WHERE f.fault IN ('', 't') AND p.after || f.initial IN ('s', 'u', 'su', 'ua', 'au')
      UNION ALL SELECT 'R', CASE p.after WHEN 'u' THEN 'a' ELSE 'u' END, CASE f.fault WHEN 't' THEN 3 ELSE 2 END,
        CASE p.after WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) WHERE f.fault IN ('', 't')) e)
  QUALIFY row_number() OVER (PARTITION BY conv_id, to_ ORDER BY cost, audit) = 1),
ends AS (SELECT b.conv_id, b.cost + 2 * p.k AS cost, b.audit || p.edits AS audit, CASE WHEN p.lines = '' AND b.body <> '' THEN left(b.body, -1) ELSE b.body || p.lines END AS body
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN pads p ON p.state = b.state AND p.after IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 2 * p.k, b.audit || p.edits) = 1)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(e.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query(REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return audit_conversations(damaged(table(spark, sf_dir, "conversations")), present="present")
