"""Query of the licence scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.base import query, table
from seriesloom.llm.license_scan import scan_licenses

#: The table has no paths: sources are folders of folders of a hundred documents, whose first one is the licence file.
PATH = """concat_ws('/', source, cast(doc_id div 100 as string), CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE concat('doc', doc_id, '.txt') END)"""


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that every document states or inherits."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text")
    return scan_licenses(files).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", "directory")
