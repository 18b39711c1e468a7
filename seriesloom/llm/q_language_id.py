"""Query of the language identification."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.language_id import identify, train_dictionaries


def held_out() -> Column:
    """A fixed quarter of the documents; one without an id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def models(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries learned from the documents that are not held out."""
    return train_dictionaries(docs.filter(~held_out()))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a quarter is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = models(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")
