"""Writing: prepared tables, splits, forecasts, metrics, reports, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.metrics import best_models
from seriesloom.operators.profile import profile


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a table as parquet, or as CSV with a header; returns the path."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def write_splits(df: DataFrame, path: str, *, split: str = "split", fmt: str = "parquet") -> str:
    """Train and test in one write, one folder each."""
    return write_table(df, path, fmt=fmt, partition_by=[split])


def write_forecasts(forecasts: DataFrame, path: str, *, fmt: str = "parquet") -> str:
    """One folder per model."""
    return write_table(forecasts, path, fmt=fmt, partition_by=["model"])


def write_metrics(scores: DataFrame, path: str, *, fmt: str = "parquet") -> str:
    """The score table."""
    return write_table(scores, path, fmt=fmt)


def write_metrics_json(scores: DataFrame, path: str) -> str:
    """The scores as JSON, one folder per model."""
    return write_table(scores, path, fmt="json", partition_by=["model"])


def write_report(report: DataFrame, path: str) -> str:
    """The reports that passed, as JSON."""
    return write_table(report.where("is_valid"), path, fmt="json")


def write_profile(df: DataFrame, path: str) -> str:
    """The dataset profile."""
    return write_table(profile(df), path)


def write_summary(scores: DataFrame, path: str, *, keys: Sequence[str] = ()) -> str:
    """Best model per metric together with all scores, as JSON."""
    best = best_models(scores, keys=keys).select(*keys, F.lit("best").alias("part"), "metric", "model", "value")
    metrics = [c for c in ("rmse", "mae", "mse", "r2", "mape") if c in scores.columns]
    every = scores.unpivot([*keys, "model"], metrics, "metric", "value").select(*keys, F.lit("all").alias("part"), "metric", "model", "value")
    return write_table(best.unionByName(every), path, fmt="json")
