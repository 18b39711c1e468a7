"""Text to number and text to time, with bad values turned to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions.calendar import column


def price(c: Column | str) -> Column:
    """``₹1,099`` -> 1099.0; anything else that is no number -> null."""
    bare = F.trim(F.regexp_replace(column(c).cast("string"), "[₹,]", ""))
    return bare.try_cast("double")


def percent(c: Column | str) -> Column:
    """``64%`` -> 64.0; blank -> null."""
    return F.trim(F.replace(column(c).cast("string"), F.lit("%"), F.lit(""))).try_cast("double")


def rating(c: Column | str) -> Column:
    """A rating; the placeholder ``|`` and blanks -> null."""
    text = F.trim(column(c).cast("string"))
    return F.when(~text.isin("", "|"), text.try_cast("double"))


def count_text(c: Column | str) -> Column:
    """``24,269`` -> 24269.0; blank -> null."""
    return F.trim(F.replace(column(c).cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def number(c: Column | str) -> Column:
    """Any value as a double, null where it is none."""
    return column(c).try_cast("double")


def within(c: Column | str, low, high) -> Column:
    """The value where it lies in [low, high], else null."""
    c = column(c)
    return F.when(c.between(low, high), c)


def no_nan(c: Column | str) -> Column:
    """NaN as null, so that one marker stands for a missing value."""
    c = column(c)
    return F.when(~F.isnan(c), c)


# The text layouts tried for a time after the standard one, in this order.
TIME_LAYOUTS = ("yyyy/MM/dd", "MM/dd/yyyy")
OFFSET_LAYOUT = "MMM dd yyyy HH:mm:ss Z"
OFFSET_TEXT = r"^[A-Za-z]{3} ([A-Za-z]{3} \d{2} \d{4} \d{2}:\d{2}:\d{2}) GMT([+-]\d{4}).*$"


def lenient_time(c: Column | str) -> Column:
    """A timestamp, or null where the text is none; mixed offsets become UTC instants.

    A zone name in brackets after the offset is dropped: the offset decides.
    """
    text = F.trim(column(c).cast("string"))
    bare = F.regexp_replace(text, OFFSET_TEXT, "$1 $2")
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(p)) for p in TIME_LAYOUTS]
    tries.append(F.try_to_timestamp(bare, F.lit(OFFSET_LAYOUT)))
    return F.coalesce(*tries)


def strict_time(c: Column | str) -> Column:
    """A timestamp; fails the query on a value that is none."""
    return F.to_timestamp(column(c))


def name_has(name: str, words: tuple[str, ...]) -> bool:
    """True if the lower-cased column name holds any of the words."""
    low = name.lower()
    return any(word in low for word in words)
