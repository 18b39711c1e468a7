"""Query of the mixing of sources, with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.mixing import EPOCHS, SEED, mix

LEVELS = ("domain", "lang", "source")
#: There is no domain in the table: sources fall into two by a digit of their hash.
DOMAIN = "CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'curated' ELSE 'web' END"
WEIGHTS = {"domain": "CASE WHEN domain = 'curated' THEN 2 ELSE 1 END", "lang": "CASE WHEN lang = 'en' THEN 3 ELSE 2 END", "source": "1"}
SHARE = 0.8


def level_sql(k: int) -> str:
    """CTEs that share the budget of level k - 1 among the nodes of level k."""
    path, above = ", ".join(LEVELS[: k + 1]), LEVELS[:k]
    family = f"PARTITION BY {', '.join(above)}" if above else ""
    source = f"(SELECT {path}, max(w{k}) AS w, sum(capacity) AS capacity FROM n GROUP BY {path}) " + (f"JOIN g{k - 1} USING ({', '.join(above)})" if k else ", total")
    return f"""
a{k} AS (SELECT *, sum(capacity) OVER (o ROWS UNBOUNDED PRECEDING) - capacity AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM {source} WINDOW o AS ({family} ORDER BY capacity / w, {LEVELS[k]})),
g{k} AS (SELECT {path}, least(capacity, w * greatest(max((given - before) / rest) OVER ({family}), 0)) AS given FROM a{k}),"""


MIX = f"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
n AS (SELECT *, CAST(supply * {EPOCHS} AS DOUBLE) AS capacity, {", ".join(f"CAST({WEIGHTS[c]} AS DOUBLE) AS w{k}" for k, c in enumerate(LEVELS))} FROM leaves),
total AS (SELECT CAST(sum(supply) AS DOUBLE) * CAST({SHARE} AS DOUBLE) AS given FROM leaves),
{level_sql(0)}{level_sql(1)}{level_sql(2)}
q AS (SELECT leaves.*, CAST(floor(given + 1e-6) AS BIGINT) AS quota FROM leaves JOIN g2 USING ({", ".join(LEVELS)})),
p AS (SELECT *, CASE WHEN supply > 0 THEN quota // supply ELSE 0 END AS whole, quota - whole * supply AS rest FROM q),
r AS (SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{SEED}', whole + 1, doc_id)), tokens) AS upto
  FROM d JOIN p USING ({", ".join(LEVELS)}) WHERE quota > 0)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens,
  unnest(range(1, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM r"""


@query(MIX)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens by domain, language and source, twice as many from the curated domain."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    return mix(docs, LEVELS, WEIGHTS, SHARE).select("doc_id", *LEVELS, "epoch", "tokens")
