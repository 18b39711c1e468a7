"""Preparation of raw tables: two known layouts, any table, and the feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions import cleaning
from seriesloom.functions.calendar import add_date_parts, add_time_features, monday_weekday
from seriesloom.operators.clean import cap_iqr, cap_sigma, coerce_numbers, narrow_integers, parse_time, synthetic_index
from seriesloom.operators.fill import fill_gaps
from seriesloom.operators.lags import add_lag_features, full_frame
from seriesloom.operators.ordering import ordered_columns
from seriesloom.operators.profile import numeric_columns
from seriesloom.operators.split import chrono_split
from seriesloom.operators.timeaxis import regular_plan, regularise
from seriesloom.operators.validate import is_time, validate
from seriesloom.session import cut_lineage
from seriesloom.sources.layouts import find_layout
from seriesloom.sources.sinks import write_splits
from seriesloom.sources.tables import read_csv

PRODUCT_NUMBERS = ("discounted_price", "actual_price", "discount_percentage", "rating", "rating_count", "daily_sales")
VEHICLE_NUMBERS = ("year", "odometer", "mmr", "sellingprice")


def clean_product_prices(df: DataFrame) -> DataFrame:
    """Numbers from the text columns and the derived daily sales."""
    return df.withColumns({
        "discounted_price": cleaning.price("discounted_price"),
        "actual_price": cleaning.price("actual_price"),
        "discount_percentage": cleaning.percent("discount_percentage"),
        "rating": cleaning.rating("rating"),
        "rating_count": cleaning.count_text("rating_count"),
    }).withColumn("daily_sales", F.col("discounted_price") * F.col("rating_count"))


def prepare_product_prices(df: DataFrame, *, order: Sequence[str], end: str) -> DataFrame:
    """The product-price layout: cleaned, with consecutive days ending at ``end``."""
    return synthetic_index(clean_product_prices(df), order=order, end=end)


def prepare_vehicle_sales(df: DataFrame, *, this_year: int) -> DataFrame:
    """The vehicle-sale layout: times parsed, numbers coerced, impossible years blanked."""
    numbers = coerce_numbers(df, VEHICLE_NUMBERS)
    return parse_time(numbers.withColumn("year", cleaning.within("year", 1900, this_year + 1)), ts="saledate", lenient=True)


def prepare_generic(
    df: DataFrame, *, ts: str, y: str, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", narrow: bool = True,
) -> DataFrame:
    """Any table: parse, fill, cap, calendar parts, regular grain, whole numbers as integers.

    Numeric columns are brought to the grain; the others are kept for series that are not
    resampled and null for those that are.
    """
    parsed = df if is_time(df.schema[ts]) else parse_time(df, ts=ts, lenient=True)
    numbers = [c for c in numeric_columns(parsed) if c not in keys and c != ts]
    others = [c for c in parsed.columns if c not in (*keys, ts, *numbers)]
    base = parsed.select(*dict.fromkeys([*keys, ts, *tie, *numbers, *others])).where(F.col(ts).isNotNull()).withColumn(y, F.col(y).cast("double"))
    filled = fill_gaps(base, [y], ts=ts, keys=keys, tie=tie, grain=grain, method="linear_bfill")
    if grain == "row":
        filled = cut_lineage(filled)  # three passes follow; the windows should run once
    capped = cap_sigma(filled, y=y, keys=keys)
    parts = {"year": F.year(ts), "month": F.month(ts), "day_of_week": monday_weekday(ts), "day_of_year": F.dayofyear(ts)}
    dated = capped.withColumns(parts)
    values = [*dict.fromkeys([*numbers, *parts])]
    doubles = dated.withColumns({c: F.col(c).cast("double") for c in values})
    plan = regular_plan(base.select(*keys, ts), ts=ts, keys=keys, grain=grain)
    regular = regularise(doubles, ts=ts, y=values, keys=keys, tie=tie or [y], grain=grain, plan=plan, carry=others)
    # Whether a column is whole is asked of the written frame, so nothing above runs twice.
    return narrow_integers(cut_lineage(regular), skip=[*keys, y]) if narrow else regular


def prepare_features(
    df: DataFrame, *, ts: str, y: str | None = None, keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row", n_lags: int = 7,
) -> DataFrame:
    """Time parsed, calendar features and, with a target, lags and rolling means."""
    parsed = df if is_time(df.schema[ts]) else parse_time(df, ts=ts)
    dated = add_time_features(parsed, ts=ts)
    if y is None or y not in df.columns:
        return dated
    return add_lag_features(dated, ts=ts, y=y, keys=keys, tie=tie, grain=grain, n_lags=n_lags)


def clean_legacy(df: DataFrame, *, ts: str = "date", y: str = "sales", keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Time parsed, all columns filled forward then backward, copies dropped, target capped by quartiles."""
    parsed = df if is_time(df.schema[ts]) else parse_time(df, ts=ts)
    columns = [c for c in parsed.columns if c not in (*keys, ts, *tie)]
    filled = fill_gaps(parsed, columns, ts=ts, keys=keys, tie=tie, grain=grain)
    return cap_iqr(filled.dropDuplicates(), y=y, keys=keys, grain=grain)


def features_legacy(df: DataFrame, *, ts: str = "date", y: str = "sales", keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row") -> DataFrame:
    """Date parts, lags 1, 7, 30 and rolling means over 7 and 30 rows; rows with nulls dropped."""
    def build(w: WindowSpec):
        lags = {f"{y}_lag{k}": F.lag(y, k).over(w) for k in (1, 7, 30)}
        return lags | {f"{y}_rolling_{k}d": full_frame(F.avg(y), y, w.rowsBetween(-(k - 1), 0), k) for k in (7, 30)}
    out = ordered_columns(add_date_parts(df, ts=ts), build, ts=ts, keys=keys, tie=tie, grain=grain, back=30)
    return out.dropna(subset=[c for c in out.columns if c not in keys])


def prepare_legacy(
    df: DataFrame, *, ts: str = "date", y: str = "sales", keys: Sequence[str] = (), tie: Sequence[str] = (), grain: str = "row",
    test_size: float = 0.2, path: str | None = None,
) -> DataFrame:
    """Clean, add features, split in time order and, with a path, save both parts."""
    where = {"ts": ts, "keys": keys, "tie": tie, "grain": grain}
    featured = features_legacy(clean_legacy(df, y=y, **where), y=y, **where)
    split = chrono_split(featured, test_size=test_size, **where)
    if path:
        write_splits(split, path)
    return split


def prepare_dataset(spark, name: str, path: str, *, ts: str | None = None, y: str | None = None, **options) -> tuple[DataFrame, str, str]:
    """Read a dataset by its layout name, or a custom file, and prepare it.

    Returns the frame with the names of its time and target columns. A custom file with a
    column left out is validated first; an invalid one raises.
    """
    layout = find_layout(name)
    if layout is not None:
        raw = read_csv(spark, path, schema=layout.schema)
        prepare = prepare_product_prices if layout.name == "product_prices" else prepare_vehicle_sales
        return prepare(raw, **options), layout.ts, layout.target
    raw = read_csv(spark, path)
    if ts is None or y is None:
        report = validate(raw, ts=ts, y=y).first()
        if not report["is_valid"]:
            raise ValueError("; ".join(f"{e['code']} {e['column'] or ''}".strip() for e in report["errors"]))
        found = {f["code"]: f["column"] for f in report["suggestions"]}  # the report names what it has detected
        ts, y = ts or found["date_detected"], y or found["target_detected"]
    return prepare_generic(raw, ts=ts, y=y, **options), ts, y
