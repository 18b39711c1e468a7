"""A corpus from raw documents to packed sequences, in stages that each keep a table.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns what the
next stage gets as docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.exact_dedup import drop_exact_duplicates
from seriesloom.llm.jaccard_join import near_duplicates
from seriesloom.llm.language_id import identify
from seriesloom.llm.mixing import mix
from seriesloom.llm.packing import IDS_CRC32, pack
from seriesloom.llm.q_language_id import models
from seriesloom.llm.q_mixing import DOMAIN, LEVELS, WEIGHTS
from seriesloom.session import cut_lineage

SHARE = 1.0


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those with a narrow margin or without a letter go.

    So null, empty and blank texts go. Whole texts count, however long; repeated rows get the same
    answer each; at equal sizes the margin is narrow. A null ``lang`` teaches nothing, and an
    empty table gives an empty one. Other columns pass unread, whatever their names.
    """
    found = identify(docs.select(F.struct("*").alias("row"), "text"), models(docs.select("doc_id", "text", "lang")))
    return found.filter("NOT rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id.

    A null text equals an empty one. Whole texts are compared, however long; of repeated rows one
    stays. An empty table gives an empty one. Other columns pass, whatever their names.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate class.

    Rows are known by id and text, so of two rows of one id each is judged by its own text; equal
    rows stay or go together. Rows without an id stay, and so do null, empty and blank texts. An
    empty table gives an empty one; columns are those of ``docs``, whatever else they hold.
    """
    found = near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = cut_lineage(found.agg(F.bool_or("first").alias("stays")).filter("NOT stays").drop("stays"))
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the target weights of domains, languages and sources.

    A null text counts as empty, null languages and sources are leaves of their own. Long texts
    count whole and are never cut. An empty table gives an empty one. Columns pass through, whatever
    their names.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.expr(DOMAIN).alias("domain"), "lang", "source")
    return mix(rows, LEVELS, WEIGHTS, SHARE).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of the documents lie in sequences of 2048 tokens.

    Null and empty texts are a piece of one end id. Longer documents are cut into pieces of 2048;
    repeated rows are packed each. An empty table gives no rows; extra columns are not read.
    """
    return pack(docs, payload=IDS_CRC32)


STAGES = [("language ID", languages), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixed), ("best-fit packing", packed)]

#: SQL has neither the compression, the chosen paths nor the tokens of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
