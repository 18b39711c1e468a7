"""Query of the packing."""

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.base import query, table
from seriesloom.llm.packing import IDS_CRC32, pack


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    packed = pack(table(spark, sf_dir, "documents"), payload=IDS_CRC32)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
