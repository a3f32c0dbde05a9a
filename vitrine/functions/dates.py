"""Month, quarter and timestamp expressions. Months travel as `yyyy-MM` text at the edges, as dates inside."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::\d{2})?)?)?)?$"
)


def month_start(month: Column) -> Column:
    """First day of a strict `yyyy-MM` month, NULL for anything else."""
    return F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.concat(month, F.lit("-01")).try_cast("date"))


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def shift_month(month: Column, offset: Column | int) -> Column:
    """`yyyy-MM` plus a signed number of months, as `yyyy-MM`."""
    return month_text(F.add_months(month_start(month), offset))


def month_midpoint(month: Column) -> Column:
    """The 15th of a `yyyy-MM` month."""
    return F.date_add(month_start(month), 14)


def whole_months(earlier: Column, later: Column) -> Column:
    """Whole calendar months from one date to another; days within the month do not matter."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def prior_year_quarter(quarter: Column) -> Column:
    """`2026Q2` becomes `2025Q2`; text that is no quarter comes back unchanged."""
    good = quarter.rlike(r"^\d{4}") & quarter.contains("Q") & (F.length(quarter) >= 6)
    year = F.substring(quarter, 1, 4).try_cast("int") - 1
    return F.when(good, F.concat(year.cast("string"), F.substr(quarter, F.lit(5)))).otherwise(quarter)


def quarter_of(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def archive_day(timestamp: Column) -> Column:
    """Date of a 14-digit archive timestamp, NULL unless the first eight characters are a real day."""
    head = F.substring(timestamp, 1, 8)
    return F.when(head.rlike(r"^[0-9]{8}$"), F.try_to_date(head, "yyyyMMdd"))


def iso_day(text: Column) -> Column:
    """Local calendar day of an ISO-8601 instant; the offset is not applied. NULL when it is no instant."""
    return F.when(text.rlike(_ISO), F.substring(text, 1, 10).try_cast("date"))


def iso_month_prefix(text: Column) -> Column:
    """`yyyy-MM` prefix of ISO text, taken as written."""
    return F.substring(text, 1, 7)


def epoch_millis_iso(millis: Column) -> Column:
    """Epoch milliseconds as ISO-8601 UTC text with second precision."""
    return F.date_format(F.timestamp_millis(millis.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
