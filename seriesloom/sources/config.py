"""Run settings: written as JSON and read back with a fixed precedence."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.layouts import LAYOUTS

COLUMN_SCHEMA = "date_col string, target_col string"


def write_config(spark: SparkSession, settings: dict, path: str) -> str:
    """The settings of a run as one JSON row."""
    row = {k: None if v is None else str(v) for k, v in settings.items()}
    schema = ", ".join(f"`{k}` string" for k in row)
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").json(path)
    return path


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """The column settings in a JSON file, one row; nulls where there is no file."""
    try:
        found = spark.read.schema(COLUMN_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException:
        found = spark.createDataFrame([], COLUMN_SCHEMA)
    return found.agg(F.first("date_col", ignorenulls=True).alias("date_col"), F.first("target_col", ignorenulls=True).alias("target_col"))


def merge_columns(defaults: DataFrame, config: DataFrame, info: DataFrame) -> DataFrame:
    """The run config overrides the defaults; the column info only fills blanks. One row each."""
    one = lambda df: df.select(F.struct("date_col", "target_col")).scalar()
    wide = defaults.withColumns({"_config": one(config), "_info": one(info)})
    blank = lambda c: F.nullif(c, F.lit(""))
    picked = {c: F.coalesce(blank(F.col(f"_config.{c}")), blank(F.col(c)), blank(F.col(f"_info.{c}"))) for c in ("date_col", "target_col")}
    return wide.withColumns(picked).drop("_config", "_info")


def dataset_info(spark: SparkSession, folder: str) -> DataFrame:
    """Name, type and columns of the dataset behind a result folder, one row."""
    low = folder.lower()
    known = next(((alias, kind) for kind in LAYOUTS.values() for alias in kind.aliases if alias in low), None)
    if known:
        alias, kind = known
        first = (alias.upper(), kind.name, kind.ts, kind.target)
    else:
        first = (folder.rstrip("/").rsplit("/", 1)[-1].split("_")[0].upper() or "DATASET", "custom", None, None)
    defaults = spark.createDataFrame([first], "dataset_name string, dataset_type string, date_col string, target_col string")
    return merge_columns(defaults, read_columns(spark, f"{folder}/config.json"), read_columns(spark, f"{folder}/column_info.json"))
