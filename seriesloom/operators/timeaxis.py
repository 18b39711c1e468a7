"""The time axis: grain, calendar, gaps, frequency, regularising and future dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import column
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.ordering import join_facts, join_on_keys, ordered_columns
from seriesloom.operators.quantiles import quantiles_of_counts

# A gap share below this is repaired; gap medians below these days name the class.
GAP_SHARE_LIMIT = 20.0
CLASS_LIMITS = (("D", 2), ("W", 8), ("M", 32))

STEP = {"H": "1 hour", "D": "1 day", "W": "7 days", "M": "1 month"}


def bin_of(ts: Column | str, freq: str) -> Column:
    """The bin of a time: its hour, its day, the Sunday that ends its week, its month's last day."""
    ts = column(ts)
    day = F.to_date(ts)
    if freq == "H":
        return F.date_trunc("hour", ts)
    return {"D": day, "W": F.next_day(F.date_sub(day, 1), "SU"), "M": F.last_day(day)}[freq]


def bins_between(first: Column, last: Column, freq: str) -> Column:
    """All bins from the first to the last one, as an array."""
    if freq == "M":
        # Step from month start to month start: month ends have no constant step.
        starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
        return F.transform(starts, F.last_day)
    return F.sequence(first, last, F.expr(f"interval {STEP[freq]}"))


def to_grain(
    df: DataFrame, *, ts: str, y: str | Sequence[str], keys: Sequence[str] = (), freq: str = "D", how: str = "mean",
    empty_bins: bool = False,
) -> DataFrame:
    """One row per series and bin; ``how`` is mean or sum. Partial sums leave each scan task.

    ``empty_bins`` adds the bins that no row falls in, with null values.
    """
    columns = [y] if isinstance(y, str) else list(y)
    stat = {"mean": F.avg, "sum": F.sum}[how]
    binned = df.select(*keys, bin_of(ts, freq).alias(ts), *columns).where(F.col(ts).isNotNull())
    grain = binned.groupBy(*keys, ts).agg(*[stat(c).alias(c) for c in columns])
    if not empty_bins:
        return grain
    spine = calendar(grain, ts=ts, keys=keys, freq=freq)
    return join_on_keys(spine, grain, [*keys, ts], "left")


def calendar(df: DataFrame, *, ts: str, keys: Sequence[str] = (), freq: str = "D") -> DataFrame:
    """Every bin between a series' first and last one."""
    ends = df.groupBy(*keys).agg(F.min(bin_of(ts, freq)).alias("_lo"), F.max(bin_of(ts, freq)).alias("_hi"))
    return ends.where("_lo is not null").select(*keys, F.explode(bins_between(F.col("_lo"), F.col("_hi"), freq)).alias(ts))


def calendar_gaps(df: DataFrame, *, ts: str, keys: Sequence[str] = (), freq: str = "D") -> DataFrame:
    """The bins of the calendar that no row falls in."""
    present = df.select(*keys, bin_of(ts, freq).alias(ts)).distinct()
    return join_on_keys(calendar(present, ts=ts, keys=keys, freq=freq), present, [*keys, ts], "left_anti")


def gap_share(df: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days of the range, days present, days missing and the missing share in percent."""
    days = df.select(*keys, F.to_date(ts).alias("_day")).where("_day is not null").distinct()
    return days.groupBy(*keys).agg(
        (F.datediff(F.max("_day"), F.min("_day")) + 1).cast("long").alias("days"),
        F.count("_day").alias("days_present"),
    ).select(
        *keys, "days", "days_present", (F.col("days") - F.col("days_present")).alias("days_missing"),
        ((F.col("days") - F.col("days_present")) * 100.0 / F.col("days")).alias("missing_pct"),
    )


def keep_last(df: DataFrame, *, ts: str, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The last row per series and timestamp by tie-break; an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    latest = F.max_by(F.struct(*rest), F.struct(*tie)).alias("_row")
    return df.groupBy(*keys, ts).agg(latest).select(*[c if c not in rest else f"_row.{c}" for c in df.columns])


def instants(df: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """The distinct times of each series."""
    return df.select(*keys, ts).where(F.col(ts).isNotNull()).distinct()


def time_grain(df: DataFrame, ts: str, grain: str) -> str:
    """Distinct dates are bounded by the calendar, so dates never need the row path."""
    return "bin" if isinstance(df.schema[ts].dataType, T.DateType) else grain


def step_lengths(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Each distinct time with ``step_seconds``, the time since the one before it."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    stepped = ordered_columns(
        instants(df, ts=ts, keys=keys), lambda w: {"_before": F.lag(ts).over(w)},
        ts=ts, keys=keys, grain=time_grain(df, ts, grain), back=1)
    return stepped.withColumn("step_seconds", seconds(F.col(ts)) - seconds(F.col("_before"))).drop("_before")


def counted_steps(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Rows per distinct step length, with what the month tests need."""
    month_index = F.year(ts) * 12 + F.month(ts)
    return step_lengths(df, ts=ts, keys=keys, grain=grain).groupBy(*keys, "step_seconds").agg(
        F.count(F.lit(1)).alias("_c"),
        F.bool_and(F.dayofmonth(ts) == 1).alias("_starts"),
        F.bool_and(F.to_date(ts) == F.last_day(F.to_date(ts))).alias("_ends"),
        F.min(month_index).alias("_m0"), F.max(month_index).alias("_m1"))


def regular_facts(counted: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``freq`` per series: days, weeks, hours, minutes and seconds need one step length;
    months need month starts or month ends one month apart. Fewer than three times have none.
    """
    facts = counted.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.min("step_seconds").alias("_lo"), F.max("step_seconds").alias("_hi"),
        F.bool_and("_starts").alias("_starts"), F.bool_and("_ends").alias("_ends"),
        (F.max("_m1") - F.min("_m0") + 1).alias("_months"))
    return facts.select(*keys, regular_name().alias("freq"))


def median_facts(counted: DataFrame, *, keys: Sequence[str], grain: str) -> DataFrame:
    """``median_days`` and ``freq_class`` per series."""
    medians = quantiles_of_counts(
        counted.where("step_seconds is not null").select(*keys, "step_seconds", "_c"), keys=keys, value="step_seconds", count="_c", qs=(0.5,), grain=grain)
    days = medians.select(*keys, (F.col("quantile") / 86400).alias("median_days"))
    return days.withColumn("freq_class", class_of(F.col("median_days")))


def regular_name() -> Column:
    lo = F.col("_lo")
    units = ((7 * 86400, "W"), (86400, "D"), (3600, "H"), (60, "T"), (1, "S"))  # fixed values
    names = [
        F.when(lo % size == 0, F.concat(F.when(lo == size, "").otherwise((lo / size).cast("long").cast("string")), F.lit(code)))
        for size, code in units
    ]
    monthly = F.col("_months") == F.col("_n")
    freq = F.when(F.col("_n") < 3, None).when(lo == F.col("_hi"), F.coalesce(*names))
    return freq.when(F.col("_starts") & monthly, "MS").when(F.col("_ends") & monthly, "M")


def infer_frequency(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """One row per series: ``freq`` if its steps are regular, else null."""
    return regular_facts(counted_steps(df, ts=ts, keys=keys, grain=grain), keys=keys)


def frequency_class(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Median step in days and the class it names: D, W, M or null."""
    return median_facts(counted_steps(df, ts=ts, keys=keys, grain=grain), keys=keys, grain=time_grain(df, ts, grain))


def class_of(median_days: Column) -> Column:
    whole = F.floor(median_days)
    name = F.lit(None).cast("string")
    for code, limit in reversed(CLASS_LIMITS):
        name = F.when(whole < limit, code).otherwise(name)
    return name


def regularise(
    df: DataFrame, *, ts: str, y: str | Sequence[str], keys: Sequence[str] = (), tie: Sequence[str], grain: str = "row",
    plan: DataFrame | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Bring irregular series with few gaps to a regular grain; leave the others as they are.

    Per series: a regular one keeps all its rows. An irregular one keeps the last row per
    time; if between 0 and 20 percent of its days are missing it is averaged to the grain
    its median step names, and empty bins are interpolated. The decision is a column, so
    series of all kinds go through in one job. Returns keys, time, values and ``action``.
    ``plan`` takes the decisions of :func:`regular_plan` where they were made on a cheaper
    frame of the same times. Columns to ``carry`` along are null where rows are averaged.
    """
    columns = [y] if isinstance(y, str) else list(y)
    carry = [c for c in carry if c not in (*keys, ts, *columns)]
    rows = df.select(*dict.fromkeys([*keys, ts, *columns, *carry, *tie]))
    plan = regular_plan(df, ts=ts, keys=keys, grain=grain) if plan is None else plan
    out_cols = [*keys, ts, *columns, *carry, "action"]
    planned = join_facts(rows, plan, keys)
    regular = planned.where("action = 'regular'").select(*out_cols)
    last = keep_last(planned.where("action <> 'regular'"), ts=ts, tie=tie, keys=keys)
    kept = last.where("action = 'deduplicated'").select(*out_cols)

    def by_class(make: dict[str, Column]) -> Column:
        out = F.lit(None)
        for code, value in make.items():
            out = F.when(F.col("action") == f"resampled_{code}", value).otherwise(out)
        return out

    group = [*keys, "action"]
    codes = [code for code, _ in CLASS_LIMITS]
    binned = last.where(F.col("action").startswith("resampled")).withColumn(ts, by_class({c: bin_of(ts, c) for c in codes}))
    means = binned.groupBy(*group, ts).agg(*[F.avg(c).alias(c) for c in columns])
    ends = means.groupBy(*group).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    spans = by_class({c: bins_between(F.col("_lo"), F.col("_hi"), c) for c in codes})
    spine = ends.select(*group, F.explode(spans).alias(ts))
    bins = join_on_keys(spine, means, [*group, ts], "left")
    filled = fill_gaps(bins, columns, ts=ts, keys=group, grain="bin", method="linear")
    lost = {c: F.lit(None).cast(df.schema[c].dataType) for c in carry}
    resampled = filled.withColumn(ts, F.col(ts).cast(df.schema[ts].dataType)).withColumns(lost).select(*out_cols)
    return regular.unionByName(kept).unionByName(resampled)


def regular_plan(df: DataFrame, *, ts: str, keys: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Per series the action: regular, deduplicated or resampled_D/W/M."""
    gaps = gap_share(df, ts=ts, keys=keys).select(*keys, "days_missing", "missing_pct")
    counted = counted_steps(df, ts=ts, keys=keys, grain=grain)
    facts = join_on_keys(regular_facts(counted, keys=keys), gaps, keys)
    facts = join_on_keys(facts, median_facts(counted, keys=keys, grain=time_grain(df, ts, grain)), keys, "left")
    fits = (F.col("days_missing") > 0) & (F.col("missing_pct") < GAP_SHARE_LIMIT) & F.col("freq_class").isNotNull()
    action = F.when(F.col("freq").isNotNull(), "regular").when(fits, F.concat(F.lit("resampled_"), F.col("freq_class"))).otherwise("deduplicated")
    return facts.select(*keys, action.alias("action"))


def future_dates(df: DataFrame, *, ts: str, keys: Sequence[str] = (), steps: int = 30, freq: str = "D") -> DataFrame:
    """The ``steps`` bins after each series' last one, numbered from 1."""
    ends = df.groupBy(*keys).agg(F.max(bin_of(ts, freq)).alias("_last"))
    return ends.select(*keys, F.posexplode(dates_after(F.col("_last"), steps, freq)).alias("_i", ts)).select(
        *keys, (F.col("_i") + 1).alias("step"), ts)


def dates_after(last: Column, steps: int | Column, freq: str = "D") -> Column:
    """An array of the next ``steps`` bins after ``last``."""
    numbers = F.sequence(F.lit(1), F.lit(steps) if isinstance(steps, int) else steps)
    move = {
        "H": lambda i: last + F.make_dt_interval(F.lit(0), i),
        "D": lambda i: F.date_add(last, i),
        "W": lambda i: F.date_add(last, i * 7),
        "M": lambda i: F.last_day(F.add_months(last, i)),
    }[freq]
    return F.transform(numbers, move)


def future_dates_from(spark, start: str, *, steps: int = 30) -> DataFrame:
    """``steps`` days after a given day, for a forecast without data at hand."""
    first = F.to_date(F.lit(start))
    return spark.range(1).select(F.posexplode(dates_after(first, steps)).alias("_i", "date")).select(
        (F.col("_i") + 1).alias("step"), "date")
