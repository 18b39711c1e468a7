"""Query of the quality resampling."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.quality_resampling import resample


@query()
def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and key; as large a share is kept as is good among the labelled ones."""
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resample(table(spark, sf_dir, "documents"), labels.filter("quality = 1"), float(share or 0))
