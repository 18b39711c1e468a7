"""Query of the secret scan."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.secret_scan import find_secrets


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and a digest of the base spans, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", *map(number_of, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
