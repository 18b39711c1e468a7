"""Query of the exact top-k search, with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.topk_search import top_k

SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@query(SEARCH)
def op5_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
