"""Gap filling: forward/backward fill and linear interpolation by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import nearest_known, with_position


def between_known(c: str, position: str) -> Column:
    """The straight line between the known neighbours of a row.

    Before the first known value there is none; after the last one it stays level.
    """
    before, after = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    share = (F.col(position) - before["t"]) / (after["t"] - before["t"])
    line = before["v"] + (after["v"] - before["v"]) * share
    return F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(before.isNull(), None).when(after.isNull(), before["v"]).otherwise(line)


def fill_gaps(
    df: DataFrame, columns: Sequence[str], *, ts: str, keys: Sequence[str] = (), tie: Sequence[str] = (),
    grain: str = "row", method: str = "ffill_bfill", **sizes: int,
) -> DataFrame:
    """Replace nulls of the columns.

    ``ffill_bfill`` takes the last known value, then the first later one;
    ``linear`` interpolates by position; ``linear_bfill`` does both, so that only a
    series without any known value keeps its nulls.
    """
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t")
    near = nearest_known(placed, columns, keys=keys, position="_t", grain=grain, **sizes)
    fills = {}
    for c in columns:
        before, after = F.col(f"_prev_{c}")["v"], F.col(f"_next_{c}")["v"]
        if method == "ffill_bfill":
            fills[c] = F.coalesce(before, after)
        elif method == "linear":
            fills[c] = between_known(c, "_t")
        elif method == "linear_bfill":
            fills[c] = F.coalesce(between_known(c, "_t"), after.cast("double"))
        else:
            raise ValueError(f"unknown fill method {method!r}")
    return near.withColumns(fills).select(*df.columns)
