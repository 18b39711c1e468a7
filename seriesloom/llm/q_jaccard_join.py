"""Query of the similarity join."""

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.base import query, table
from seriesloom.llm.jaccard_join import near_duplicates


@query()
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and the number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")
