"""Frames with everything that real tables have: nulls, empty and long texts, ties, repeats, odd columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from frames import messy_rows  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHES = ("row", "id", "digest", "kept", "score", "lang_pred", "tokens", "epoch", "repeats", "size", "node", "sets", "block", "number", "copies", "spans", "license")


@pytest.fixture(scope="session")
def messy(spark):
    frame = spark.createDataFrame(messy_rows(), SCHEMA)
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
