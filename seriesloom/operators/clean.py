"""Row and column cleaning: time parsing, coercion, capping, scaling, renaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import cleaning
from seriesloom.operators.ordering import join_facts, with_position
from seriesloom.operators.profile import numeric_columns, unfold
from seriesloom.operators.quantiles import exact_quantiles


def parse_time(df: DataFrame, *, ts: str, lenient: bool = False) -> DataFrame:
    """Parse the time column. Strict fails on a bad value; lenient drops its row."""
    if not lenient:
        return df.withColumn(ts, cleaning.strict_time(ts))
    return df.withColumn(ts, cleaning.lenient_time(ts)).where(F.col(ts).isNotNull())


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the columns into doubles, bad values into null."""
    return df.withColumns({c: cleaning.number(c) for c in columns})


def synthetic_index(df: DataFrame, *, order: Sequence[str], end: str, name: str = "date") -> DataFrame:
    """Give the rows, in the given order, consecutive days that end at ``end``."""
    placed = with_position(df, ts=order[0], tie=order[1:], position="_t", size="_n")
    back = (F.col("_n") - 1 - F.col("_t")).cast("int")
    return placed.withColumn(name, F.date_sub(F.to_date(F.lit(end)), back)).drop("_t", "_n")


def cap_sigma(
    df: DataFrame, *, y: str, keys: Sequence[str] = (), sigmas: float = 3.0, max_share: float = 0.05,
) -> DataFrame:
    """Clip to mean +- sigmas * std, for series where fewer than ``max_share`` rows lie outside."""
    stats = df.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"))
    low, high = F.col("_mean") - sigmas * F.col("_std"), F.col("_mean") + sigmas * F.col("_std")
    limits = stats.select(*keys, low.alias("_low"), high.alias("_high"))
    outside = (F.col(y) > F.col("_high")) | (F.col(y) < F.col("_low"))
    shares = join_facts(df.select(*keys, y), limits, keys).groupBy(*keys, "_low", "_high").agg(
        (F.count(F.when(outside, 1)) < F.lit(max_share) * F.count(F.lit(1))).alias("_cap"))
    joined = join_facts(df, shares, keys)
    clipped = F.when(F.col("_cap") & F.col(y).isNotNull(), F.least(F.greatest(F.col(y), F.col("_low")), F.col("_high"))).otherwise(F.col(y))
    return joined.withColumn(y, clipped).select(*df.columns)


def cap_iqr(df: DataFrame, *, y: str, keys: Sequence[str] = (), factor: float = 1.5, grain: str = "row") -> DataFrame:
    """Clip to the quartiles widened by ``factor`` times their distance."""
    spots = exact_quantiles(df, [y], keys=keys, qs=(0.25, 0.75), grain=grain)
    q1, q3 = (F.max(F.when(F.col("q") == q, F.col("quantile"))) for q in (0.25, 0.75))
    limits = spots.groupBy(*keys).agg((q1 - factor * (q3 - q1)).alias("_low"), (q3 + factor * (q3 - q1)).alias("_high"))
    joined = join_facts(df, limits, keys, "left")
    clipped = F.when(F.col(y) < F.col("_low"), F.col("_low")).when(F.col(y) > F.col("_high"), F.col("_high")).otherwise(F.col(y))
    return joined.withColumn(y, clipped).select(*df.columns)


def scale_limits(train: DataFrame, *, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """The value range per series that :func:`minmax_scale` maps to (0, 1)."""
    return train.groupBy(*keys).agg(F.min(y).alias("scale_min"), F.max(y).alias("scale_max"))


def minmax_scale(df: DataFrame, limits: DataFrame, *, y: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """(y - min) / (max - min) by the limits; a flat series scales to 0."""
    span = F.col("scale_max") - F.col("scale_min")
    scaled = (F.col(y) - F.col("scale_min")) / F.when(span == 0, 1.0).otherwise(span)
    return join_facts(df, limits, keys).withColumn(out or y, scaled).drop("scale_min", "scale_max")


def minmax_unscale(df: DataFrame, limits: DataFrame, *, y: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The inverse of :func:`minmax_scale`."""
    span = F.col("scale_max") - F.col("scale_min")
    raw = F.col(y) * F.when(span == 0, 1.0).otherwise(span) + F.col("scale_min")
    return join_facts(df, limits, keys).withColumn(out or y, raw).drop("scale_min", "scale_max")


def whole_number_columns(df: DataFrame, *, skip: Sequence[str] = ()) -> DataFrame:
    """Per numeric column whether all its values (null as 0) are whole numbers."""
    columns = [c for c in numeric_columns(df) if c not in skip]
    wide = df.agg(*[F.bool_and(F.coalesce(F.col(c), F.lit(0)) == F.floor(F.coalesce(F.col(c), F.lit(0)))).alias(c) for c in columns])
    return unfold(wide, {c: {"whole": c} for c in columns})


def narrow_integers(df: DataFrame, *, skip: Sequence[str] = ()) -> DataFrame:
    """Cast numeric columns without fractions to bigint, except the skipped ones.

    The answer of one aggregate, one flag per column, decides the schema.
    """
    flags = whole_number_columns(df, skip=skip).where("whole").collect()  # one row per column
    return df.withColumns({r["column"]: F.col(r["column"]).cast("long") for r in flags})


def pick_target(df: DataFrame, target: str | None = None) -> str:
    """The named column, else the first numeric one."""
    if target is not None and target in df.columns:
        return target
    numeric = numeric_columns(df)
    if not numeric:
        raise ValueError("no numeric column to forecast")
    return numeric[0]


def to_model_contract(df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys, ``ds`` and ``y`` only."""
    return df.select(*keys, F.col(ts).alias("ds"), F.col(y).alias("y"))


def rename_time(df: DataFrame, *, wanted: str, found: str = "date") -> DataFrame:
    """Rename ``found`` to ``wanted`` where only the former exists."""
    return df.withColumnRenamed(found, wanted) if found in df.columns and wanted not in df.columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every float column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: cleaning.no_nan(c) for c in floats})
