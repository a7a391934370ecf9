"""Trip dates to month and length, with the reason where a date is unusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwright.functions.text import clean


def iso_date(c: Column) -> Column:
    """A date written as 2023-01-05 or 20230105; else null."""
    c = clean(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")).when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))


def trip_time(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """(month, elapsed days, reason): an inverted range keeps its month."""
    a, b = iso_date(start), iso_date(end)
    reason = F.when(clean(start).isNull() | clean(end).isNull(), "missing_start_or_end_date").when(a.isNull() | b.isNull(), "unparseable_date").when(b < a, "inverted_date_range")
    usable = reason.isNull()
    return F.when(usable | (reason == "inverted_date_range"), F.date_format(a, "MM")), F.when(usable, F.date_diff(b, a)), reason
