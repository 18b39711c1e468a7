"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Equal texts meet in three steps, and each step groups by the digest *and* the whole text:

1. every task combines the equal texts it has read (the map side of the first grouping);
2. the results meet in salted groups, ``salts`` groups for one text at most, so that a text
   with a third of all rows never gathers in one task;
3. the salt winners, at most ``salts`` rows a text, are combined globally.

What comes out is one short row per digest. Documents find their class by joining on the
digest, which the adaptive skew join splits for a hot text. A digest that stands for several
texts (never seen with SHA-256, easily made with a weak digest) sends its documents through a
join on the text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

SALTS = 16


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def text_classes(docs: DataFrame, doc_id: str, text: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct text: ``digest, norm, keep_id, group_size``."""
    rows = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("norm"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.withColumn("digest", digest(F.col("norm"))).groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    return salted.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("size").alias("group_size"))


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest, repeats`` for every row of ``docs``.

    The row with the smallest id of equal texts stays. A null text counts as the empty text. A
    null id is larger than any other; if all ids of a text are null, so is ``keep_id``.
    Repeated rows (same id and text) count in ``group_size`` and come out as often as they came
    in, with one of them kept at most; ``repeats`` is their number. Other columns are not read.
    An empty table gives no rows.
    """
    found = cut_lineage(
        text_classes(docs, doc_id, text, salts, digest)
        .groupBy("digest")
        .agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    single = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("repeats"))
    joined = single.join(found.filter("texts = 1").drop("texts"), "digest")
    if not found.filter("texts > 1").isEmpty():
        doubted = found.filter("texts > 1").select("digest")
        several = rows.join(doubted, "digest").groupBy("doc_id", "digest", "norm").agg(F.count("*").alias("repeats"))
        classes = text_classes(docs, doc_id, text, salts, digest).join(doubted, "digest", "left_semi")
        joined = joined.unionByName(several.join(classes, ["digest", "norm"]).select(joined.columns))
    copies = joined.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")).alias("copy"))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest", "repeats")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows that repeat (same id and text) leave one of them.
    """
    kept = exact_duplicates(docs, doc_id, text, salts).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), "repeats")
    # Columns of any name travel in one struct.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), sha256(normalised(text)).alias("digest"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    often = rows.filter("repeats > 1").dropDuplicates(["id", "digest"])
    return rows.filter("repeats = 1").unionByName(often).select("row.*")
