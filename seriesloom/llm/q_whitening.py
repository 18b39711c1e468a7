"""Query of the whitening."""

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.base import query, table
from seriesloom.llm.whitening import whiten


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
