"""Query of the token files."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.base import query, table
from seriesloom.llm.token_files import read_tokens, write_tokens
from seriesloom.session import WRITTEN, use_checkpoint_dir


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from files of packed token ids."""
    folder = f"{use_checkpoint_dir(spark)}/{WRITTEN}{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, ids=False)
