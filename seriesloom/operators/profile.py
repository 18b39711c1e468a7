"""Profiles of tables and series: counts, moments, quantiles, patterns, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import monday_weekday, month_name, weekday_name
from seriesloom.operators.ordering import join_facts, join_on_keys
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.session import keep_facts


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def unfold(one_row: DataFrame, groups: dict[str, dict[str, str]], *, keys: Sequence[str] = (), label: str = "column") -> DataFrame:
    """Turn one wide aggregate row into one row per group.

    ``groups`` maps each label to {output column: column of the wide row}.
    """
    items = [F.struct(F.lit(name).alias(label), *[F.col(f"`{src}`").alias(out) for out, src in cols.items()]) for name, cols in groups.items()]
    return one_row.select(*keys, F.explode(F.array(*items)).alias("_g")).select(*keys, "_g.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None, *, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max of each numeric column, exactly."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in keys])
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*keys).agg(*[
        (f(c) if name == "count" else f(c).cast("double")).alias(f"{c}|{name}") for c in columns for name, f in stats.items()])
    long = unfold(wide, {c: {name: f"{c}|{name}" for name in stats} for c in columns}, keys=keys)
    spots = exact_quantiles(df, columns, keys=keys, grain=grain)
    group = [*keys, "column"]
    pivoted = spots.groupBy(*group).agg(*[
        F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name) for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return join_on_keys(long, pivoted, group, "left").select(*group, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def null_counts(df: DataFrame) -> DataFrame:
    """Columns with nulls and how many."""
    return completeness(df).select("column", (F.col("total") - F.col("known")).alias("nulls")).where("nulls > 0")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Known values, all rows and the known share in percent, per column."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("|total"), *[F.count(c).alias(c) for c in columns])
    long = unfold(wide, {c: {"known": c, "total": "|total"} for c in columns})
    return long.withColumn("known_pct", F.try_divide(F.col("known") * 100.0, F.col("total")))


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns of the table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: its place, name and type. Schema only; no data is read."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def profile(df: DataFrame, *, grain: str = "row") -> DataFrame:
    """The dataset profile: type, known count, nulls and numeric description per column."""
    types = F.broadcast(column_types(df))  # one row per column
    counts = completeness(df).withColumn("nulls", F.col("total") - F.col("known"))
    full = types.join(counts, "column").join(describe(df, grain=grain).drop("count"), "column", "left")
    return full.select("position", "column", "type", "total", "known", "nulls", "mean", "std", "min", "q25", "q50", "q75", "max")


def time_range(df: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time, days between them and the range as text."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    text = F.concat_ws(" to ", F.date_format("start", "yyyy-MM-dd"), F.date_format("end", "yyyy-MM-dd"))
    days = F.floor((F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))) / 86400)
    return ends.withColumns({"days": days.cast("long"), "range_text": text})


def duplicate_times(df: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct times and rows that repeat a time, per series; a missing time is one time.

    Times are counted in two steps, so that a long series needs no single distinct set.
    """
    per_time = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    return per_time.groupBy(*keys).agg(
        F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_times"),
        (F.sum("_c") - F.count(F.lit(1))).alias("duplicates"))


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance of each column, as rows."""
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return unfold(wide, {c: {"variance": c} for c in columns})


def highest_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The column of the highest variance; on a tie the earlier one."""
    rank = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(-i))])
    order = F.struct(F.col("variance"), F.element_at(rank, F.col("column")))
    return variances(df, columns).agg(F.max_by("column", order).alias("column"), F.max("variance").alias("variance"))


def target_stats(df: DataFrame, *, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))


def outlier_share(df: DataFrame, *, y: str, keys: Sequence[str] = (), sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` deviations from the series' mean: count and share of all rows."""
    stats = df.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"))
    far = F.abs(F.try_divide(F.col(y) - F.col("_mean"), F.col("_std"))) > sigmas
    return join_facts(df.select(*keys, y), stats, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(far, 1)).alias("outliers")
    ).withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("rows"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, *, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are known."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in keys])
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.groupBy(*keys).agg(*[F.expr(f"corr(`{a}`, `{b}`)").alias(f"{a}|{b}") for a, b in pairs])
    both = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    items = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{src}`").alias("corr")) for a, b, src in both]
    return wide.select(*keys, F.explode(F.array(*items)).alias("_p")).select(*keys, "_p.*")


def histogram(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins between each column's ends; the top edge is in the last bin.

    Also lists the empty bins.
    """
    group = [*keys, "column"]
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "_v").where("_v is not null")
    ends = keep_facts(long.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    slot = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0))))
    counts = join_facts(long, ends, group, written=True).groupBy(*group, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.select(*group, "bin", (F.col("_lo") + width * F.col("bin")).alias("lower"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"))
    return join_on_keys(grid, counts, [*group, "bin"], "left").fillna(0, ["n"])


def moments(df: DataFrame, *, y: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Mean, median, variance, skew and excess kurtosis, both adjusted for sample size."""
    base = df.groupBy(*keys).agg(
        F.count(y).cast("double").alias("_n"), F.avg(y).alias("mean"), F.var_samp(y).alias("variance"),
        F.skewness(y).alias("_g1"), F.kurtosis(y).alias("_g2"))
    n = F.col("_n")
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    medians = exact_quantiles(df, [y], keys=keys, qs=(0.5,), grain=grain).select(*keys, F.col("quantile").alias("median"))
    return join_on_keys(base, medians, keys, "left").select(
        *keys, "mean", "median", "variance", F.when(n > 2, skew).alias("skewness"), F.when(n > 3, kurt).alias("kurtosis"))


def skew_verdict(skew: Column) -> Column:
    # Cuts and names of the skew classes.
    return (F.when(skew < -1, "heavily left-skewed").when(skew < -0.5, "moderately left-skewed")
            .when(skew < 0.5, "approximately symmetric").when(skew < 1, "moderately right-skewed")
            .when(skew.isNotNull(), "heavily right-skewed"))


def tail_verdict(kurtosis: Column) -> Column:
    # Cuts and names of the tail classes.
    return F.when(kurtosis < -1, "platykurtic").when(kurtosis < 1, "mesokurtic").when(kurtosis.isNotNull(), "leptokurtic")


def shape_verdict(df: DataFrame, *, y: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """The moments with the classes of skew and tails they fall in."""
    return moments(df, y=y, keys=keys, grain=grain).withColumns({
        "skew_class": skew_verdict(F.col("skewness")), "tail_class": tail_verdict(F.col("kurtosis"))})


def month_pattern(df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean by calendar month, with its name."""
    return df.groupBy(*keys, F.month(ts).alias("month"), month_name(ts).alias("month_name")).agg(F.avg(y).alias("mean"))


def weekday_pattern(df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean by weekday, Monday = 0, with its name."""
    return df.groupBy(*keys, monday_weekday(ts).alias("day_of_week"), weekday_name(ts).alias("day_name")).agg(F.avg(y).alias("mean"))


def top_categories(df: DataFrame, *, category: str, k: int = 3) -> DataFrame:
    """The k most frequent known values; equal counts by name."""
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), category).limit(k)


def means(df: DataFrame, values: dict[str, Column | str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Plain means of columns or expressions, each under its name."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(name) for name, v in values.items()])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
