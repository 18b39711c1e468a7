"""Exact quantiles with linear interpolation, at any number of rows per series.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer, so
it serves ``grain="bin"`` only. For raw rows a first scan sketches each quantile to a narrow
bracket of values; a second scan counts the values inside the brackets one by one and each
stretch between brackets as a whole. The counts combine map-side and are few; placed by
range, their running sums tell which value holds a wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.ordering import join_facts, series_window
from seriesloom.session import cut_lineage, keep_facts

SKETCH = 1000  # the sketch is off by at most one part in so many
MARGIN = 3  # half a bracket's width in such parts
FEW_CELLS = 1_000_000


def running_counts(counted: DataFrame, *, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Add ``_upto`` (rows of the series up to and with this value) and ``_n`` (all rows).

    Up to ``FEW_CELLS`` values, counted in the written table, one window per series is enough;
    more are placed by range, so that a series may have any number of values.
    """
    counted = cut_lineage(counted)
    if counted.count() <= FEW_CELLS:
        upto = series_window(keys, [value]).rowsBetween(Window.unboundedPreceding, 0)
        return counted.withColumns({"_upto": F.sum(count).over(upto), "_n": F.sum(count).over(Window.partitionBy(*keys))})
    by = [*keys, value]
    placed = counted.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id())
    placed = cut_lineage(placed)  # slice numbers are read twice below
    slices = placed.groupBy(*keys, "_slice").agg(F.sum(count).alias("_rows"))
    earlier = series_window(keys, ["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *keys, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"))
    inside = series_window([*keys, "_slice"], [value]).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_upto", F.sum(count).over(inside))
    joined = join_facts(summed, slices, [*keys, "_slice"])
    return joined.withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_slice", "_before")


def quantiles_of_counts(
    counted: DataFrame, *, keys: Sequence[str], value: str, count: str, qs: Sequence[float], grain: str = "row",
) -> DataFrame:
    """One row per series and q: ``q`` and ``quantile``; ``counted`` has one row per value."""
    wanted = F.array(*[F.lit(float(q)) for q in qs])
    if grain == "bin":
        exact = F.percentile(value, wanted, F.col(count)).alias("_qs")
        packed = counted.groupBy(*keys).agg(exact)
        return packed.select(*keys, F.posexplode("_qs").alias("_i", "quantile")).select(
            *keys, wanted[F.col("_i")].alias("q"), "quantile")
    ranked = running_counts(counted.where(F.col(value).isNotNull()), keys=keys, value=value, count=count)
    first, last = F.col("_upto") - F.col(count), F.col("_upto") - 1
    spot = F.col("q") * (F.col("_n") - 1)
    hits = ranked.withColumn("q", F.explode(wanted)).where((first <= F.ceil(spot)) & (last >= F.floor(spot)))
    # At most two rows per series and q are left.
    lo, hi = F.min(value), F.max(value)
    share = F.max(spot - F.floor(spot))
    return hits.groupBy(*keys, "q").agg((lo + (hi - lo) * share).cast("double").alias("quantile"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), qs: Sequence[float] = (0.25, 0.5, 0.75), grain: str = "row",
) -> DataFrame:
    """One row per series, column and q: ``column``, ``q``, ``quantile`` of the known values."""
    group = [*keys, "column"]
    if grain == "bin":
        exact = [F.percentile(F.col(f"`{c}`").cast("double"), F.array(*[F.lit(float(q)) for q in qs])) for c in columns]
        spots = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(q)).alias("q"), e[j].alias("quantile")) for c, e in zip(columns, exact) for j, q in enumerate(qs)])
        return df.groupBy(*keys).agg(spots.alias("_s")).select(*keys, F.explode("_s").alias("_s")).select(*keys, "_s.*").where("quantile is not null")

    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "_v")
    long = long.where("_v is not null")
    wanted = sorted(set(float(q) for q in qs))
    spread = [min(1.0, max(0.0, q + side * MARGIN / SKETCH)) for q in wanted for side in (-1, 1)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in spread]), SKETCH)
    limits = keep_facts(long.groupBy(*group).agg(sketch.alias("_edges")))  # one row per series and column
    edge = lambda i: F.col("_edges")[i]
    brackets = range(len(wanted))
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(edge(2 * i), edge(2 * i + 1)) for i in brackets])
    stretch = reduce(lambda a, b: a + b, [(F.col("_v") > edge(2 * i + 1)).cast("int") for i in brackets])
    counted = join_facts(long, limits, group, written=True).groupBy(
        *group, F.when(inside, F.col("_v")).alias("_exact"), F.when(~inside, stretch).alias("_stretch")
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranked = running_counts(counted, keys=group, value="_lo", count="_c")

    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    spot = F.col("q") * (F.col("_n") - 1)
    hits = ranked.withColumn("q", F.explode(F.array(*[F.lit(q) for q in wanted]))).where((first <= F.ceil(spot)) & (last >= F.floor(spot)))

    def at(rank: Column) -> Column:
        """The value of a rank in this row; a stretch is known at its two ends only."""
        lost = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        known = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(rank == first, F.col("_lo")).when(rank == last, F.col("_hi")).otherwise(lost)
        return F.max(F.when((first <= rank) & (rank <= last), known))

    low, high = at(F.floor(spot)), at(F.ceil(spot))
    return hits.groupBy(*group, "q").agg((low + (high - low) * F.max(spot - F.floor(spot))).alias("quantile"))
