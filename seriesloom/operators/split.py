"""Chronological train/test split and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import with_position


def chrono_split(
    df: DataFrame, *, ts: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", test_size: float = 0.2,
) -> DataFrame:
    """Add ``split``: ``train`` for the first floor(n * (1 - test_size)) rows, else ``test``."""
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t", size="_n")
    border = F.floor(F.col("_n") * F.lit(1.0 - test_size))
    return placed.withColumn("split", F.when(F.col("_t") < border, "train").otherwise("test")).drop("_t", "_n")


def cv_folds(
    df: DataFrame, *, ts: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n_splits: int = 5,
) -> DataFrame:
    """One row per row, fold and role: earlier rows train, the fold's block tests.

    Every fold tests n // (n_splits + 1) rows; the last fold ends at the series' end.
    """
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t", size="_n")
    return fold_roles(placed, position="_t", size="_n", n_splits=n_splits).drop("_t", "_n")


def fold_roles(placed: DataFrame, *, position: str, size: str, n_splits: int) -> DataFrame:
    """:func:`cv_folds` for rows that carry position and length."""
    block = F.floor(F.col(size) / (n_splits + 1))
    start = F.col(size) - (n_splits - F.col("fold") + 1) * block
    role = F.when(F.col(position) < start, "train").when(F.col(position) < start + block, "test")
    folds = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    return folds.withColumn("role", role).where(F.col("role").isNotNull())
