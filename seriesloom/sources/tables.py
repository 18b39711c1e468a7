"""Reading: tables, CSV series, earlier results and metric files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.cleaning import lenient_time
from seriesloom.operators.clean import nan_to_null
from seriesloom.operators.profile import numeric_columns
from seriesloom.operators.validate import looks_like_models, named_date

METRIC_NAMES = ("RMSE", "MAE", "MAPE")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; columns and filters of later steps reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file or folder with a header.

    Give the schema for large data: without it Spark reads the file once more to infer it.
    """
    reader = spark.read.option("header", True).option("multiLine", False)
    frame = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nan_to_null(frame)


def read_indexed_csv(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV whose first column is the time."""
    frame = read_csv(spark, path, schema=schema)
    first = frame.schema.fields[0]
    if isinstance(first.dataType, T.StringType):
        return frame.withColumn(first.name, F.to_timestamp(first.name))
    return frame.withColumn(first.name, F.col(first.name).cast("timestamp"))


def read_with_time(spark: SparkSession, path: str, *, ts: str | None = None) -> DataFrame:
    """A CSV with its time column parsed; where that fails, another column named like a date is parsed.

    One aggregate tells which column parses; the frame is returned as it is if none does.
    """
    frame = read_csv(spark, path)
    if not ts or ts not in frame.columns:
        return frame
    others = [c for c in frame.columns if c != ts and named_date([c], ("date", "time"))]
    flags = frame.agg(*[(F.count(c) == F.count(lenient_time(c))).alias(c) for c in [ts, *others]]).first()
    good = next((c for c in [ts, *others] if flags[c]), None)
    return frame.withColumn(good, lenient_time(good)) if good else frame


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows, for a look at the layout."""
    return df.limit(rows)


def find_files(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    """Files under ``root``, newest first: path, modified, bytes. Contents are not read.

    The patterns are tried in order; the first one that any file matches is taken.
    """
    def listing(pattern: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        return reader.load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))

    found = None
    for pattern in patterns:
        found = listing(pattern)
        if not found.isEmpty():
            break
    return found.orderBy(F.desc("modified"), "path")


def find_results(spark: SparkSession, root: str) -> DataFrame:
    """Result folders under ``root`` by their newest file, newest first."""
    files = find_files(spark, root, ["*"])
    folder = F.regexp_extract(F.substring_index("path", root.rstrip("/") + "/", -1), r"^([^/]+)/", 1)
    named = files.select(folder.alias("result"), "modified").where("result <> ''")
    return named.groupBy("result").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "result")


def repair_metrics(df: DataFrame) -> DataFrame:
    """A metric table under the names Model, RMSE, ...

    A table with ``Model`` and a metric is taken as it is. If the first column holds model
    names, it becomes ``Model`` and the numeric columns are upper-cased; else nothing is done.
    """
    if "Model" in df.columns and any(m in df.columns for m in METRIC_NAMES):
        return df
    numeric = numeric_columns(df)
    if len(df.columns) > 1 and numeric and looks_like_models(df).first()["is_summary"]:
        return df.select(F.col(df.columns[0]).alias("Model"), *[F.col(c).alias(c.upper()) for c in numeric])
    return df


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric CSV, repaired; an unreadable file gives one row that says why."""
    try:
        return repair_metrics(read_csv(spark, path))
    except AnalysisException as problem:
        reason = F.lit(str(problem).splitlines()[0])
        return spark.range(1).select(F.lit("Error loading data").alias("Model"), reason.alias("Error"))
