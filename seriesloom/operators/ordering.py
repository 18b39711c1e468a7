"""Row positions and ordered windows that hold at any series length.

Every order-dependent operator takes ``grain``:

``"bin"``
    The frame has at most one row per series and calendar bin (the output of
    :func:`seriesloom.operators.timeaxis.to_grain`). A series is then no longer than the
    calendar, whatever the number of raw rows, so one window per series is safe.

``"row"``
    Any number of rows per series, also all of them. Positions come from a range
    partitioning on (keys, time, tie-break), so one long series, or one crowded
    timestamp, is spread over many tasks; windows then run on blocks of positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import cut_lineage, keep_facts

BLOCK_ROWS = 1_000_000
FACT_BYTES = 64 << 20  # facts up to this size, as measured, are broadcast


def series_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys.

    Without keys ``right`` is the one row of a whole-table aggregate and is read as a
    scalar subquery, which fails on a second row. With keys Spark picks the join by size.
    For calendar-grain frames; raw rows take :func:`join_facts`.
    """
    if not keys:
        one = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("_one", one).select(*left.columns, "_one.*")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", written: bool = False) -> DataFrame:
    """Bring facts, one row per group, back to raw rows without moving the rows.

    Spark cannot tell the size of an aggregate beforehand and would shuffle the rows by key,
    hot keys and all. So the facts are written down (unless they are ``written`` already)
    and measured: up to ``FACT_BYTES`` they are broadcast; larger ones are joined by shuffle,
    where the adaptive skew join splits a hot key.
    """
    if not keys:
        return join_on_keys(rows, facts, keys, how)
    facts = facts if written else keep_facts(facts)
    few = measured_bytes(facts) <= FACT_BYTES
    return join_on_keys(rows, F.broadcast(facts) if few else facts, keys, how)


def measured_bytes(df: DataFrame) -> int:
    """The size of a frame's values: 16 bytes a field, and what texts, arrays and the like hold."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    held = [F.octet_length(c) for c in wide] + [F.octet_length(F.to_json(F.struct(c))) for c in nested]
    row = sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(16 * len(df.columns)))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def with_position(
    df: DataFrame,
    *,
    ts: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    grain: str = "row",
    position: str = "t",
    size: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, and its length as ``size``.

    Rows that agree on keys, time and tie-break take positions in no fixed order; give a
    tie-break that tells rows apart.
    """
    order = [ts, *tie]
    if grain == "bin":
        out = df.withColumn(position, F.row_number().over(series_window(keys, order)).cast("long") - 1)
        return out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if size else out

    # Two more columns split crowded ties: a hash of the row and, for equal rows, the
    # partition they come from. Both are the same again if a lost task is rerun.
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = df.withColumns({"_hash": F.xxhash64(*plain), "_source": F.spark_partition_id()})
    by = [*keys, *order, "_hash", "_source"]
    placed = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_hash", "_source")
    # Partition ids are read twice below, so the placement must be written down once.
    placed = cut_lineage(placed.withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_slice", F.shiftright("_row", 33))
    # One row per slice plus one per series, as a slice border cuts at most one series.
    slices = placed.groupBy(*keys, "_slice").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = series_window(keys, ["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size:
        slices = slices.withColumn(size, F.sum("_rows").over(Window.partitionBy(*keys)))
    out = join_facts(placed, slices.drop("_rows"), [*keys, "_slice"])
    out = out.withColumn(position, F.col("_before") + F.col("_row") - F.col("_first"))
    return out.drop("_row", "_slice", "_first", "_before")


def ordered_columns(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    grain: str = "row",
    back: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows back and ``ahead`` rows ahead.

    ``build`` gets the window and returns the columns. With ``grain="row"`` the series is
    cut into blocks of positions; each block borrows the rows its edge windows need.
    """
    if grain == "bin":
        return df.withColumns(build(series_window(keys, [ts, *tie])))
    placed = with_position(df, ts=ts, keys=keys, tie=tie, grain=grain, position="_t")
    return block_columns(placed, build, keys=keys, position="_t", back=back, ahead=ahead, block_rows=block_rows).drop("_t")


def block_columns(
    placed: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    keys: Sequence[str],
    position: str,
    back: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """:func:`ordered_columns` for rows that carry their position already."""
    block_rows = max(block_rows, back, ahead, 1)
    home = F.floor(F.col(position) / block_rows)
    place = F.pmod(F.col(position), F.lit(block_rows))
    targets = F.array_compact(F.array(
        home,
        F.when(place >= block_rows - back, home + 1),
        F.when(place < ahead, home - 1),
    ))
    lent = placed.withColumn("_home", home).withColumn("_block", F.explode(targets))
    window = series_window([*keys, "_block"], [position])
    return lent.withColumns(build(window)).where("_home = _block").drop("_home", "_block")


def nearest_known(
    placed: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str],
    position: str,
    grain: str = "row",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each column ``c`` the nearest known values: structs ``_prev_c`` and ``_next_c``.

    Each struct holds the position and the value of the last known row up to here and of
    the first known row from here on. With ``grain="row"`` the values carried over block
    borders come from a table of one row per block.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("t"), F.col(c).alias("v"))) for c in columns}

    def over(group: Sequence[str]) -> dict[str, Column]:
        # The later side is read in reverse order: a frame that runs to the end of the
        # group is computed anew for every row, one that starts at its begin is not.
        ahead = Window.partitionBy(*group).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
        behind = series_window(group, [position]).rowsBetween(Window.unboundedPreceding, 0)
        out = {f"_prev_{c}": F.last(known[c], ignorenulls=True).over(behind) for c in columns}
        return out | {f"_next_{c}": F.last(known[c], ignorenulls=True).over(ahead) for c in columns}

    if grain == "bin":
        return placed.withColumns(over(keys))

    blocks = placed.withColumn("_block", F.floor(F.col(position) / block_rows))
    group = [*keys, "_block"]
    edges = blocks.groupBy(*group).agg(
        *[F.max(known[c]).alias(f"_hi_{c}") for c in columns],
        *[F.min(known[c]).alias(f"_lo_{c}") for c in columns],
    )
    past = series_window(keys, ["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *group,
        *[F.last(f"_hi_{c}", ignorenulls=True).over(past).alias(f"_in_{c}") for c in columns],
        *[F.last(f"_lo_{c}", ignorenulls=True).over(future).alias(f"_out_{c}") for c in columns],
    )
    inside = join_facts(blocks.withColumns(over(group)), carried, group)
    filled = {f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_in_{c}") for c in columns}
    filled |= {f"_next_{c}": F.coalesce(f"_next_{c}", f"_out_{c}") for c in columns}
    return inside.withColumns(filled).drop("_block", *[f"_in_{c}" for c in columns], *[f"_out_{c}" for c in columns])
