"""Month arithmetic and tolerant date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in this order.
FORMATS = ("yyyyMMdd", "M/d/yyyy", "MMM d, yyyy", "yyyy-MM-dd", "M/d/yy")


def month_index(d: Column) -> Column:
    """Months since year 0, so that differences are whole months."""
    return F.year(d) * 12 + F.month(d) - 1


def month_start(index: Column) -> Column:
    """First day of a month given by its index."""
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def month_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def parse_date(s: Column) -> Column:
    """First of FORMATS that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS]).cast("date")


def midpoint(start: Column, end: Column) -> Column:
    """Middle day of two dates; the end if the start is missing."""
    return F.when(start.isNull(), end).otherwise(F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int")))


def months_between_floor(later: Column, earlier: Column) -> Column:
    return F.greatest(month_index(later) - month_index(earlier), F.lit(0))


def years_since(later: Column, earlier: Column) -> Column:
    return F.greatest(F.datediff(later, earlier) / F.lit(365.25), F.lit(0.0))


def in_months(d: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """1 if d lies in the closed range of (year, month)."""
    lo, hi = (y * 12 + m - 1 for y, m in (first, last))
    return month_index(d).between(lo, hi).cast("int")


def repaired(noted: Column, resolved: Column, year: Column) -> tuple[Column, Column]:
    """Dates before 1990 are artefacts: a start becomes 1 January of the given year, an end becomes null."""
    edge = F.lit("1990-01-01").cast("date")
    start = F.when(noted < edge, F.make_date(year.cast("int"), F.lit(1), F.lit(1))).otherwise(noted)
    return start, F.when(resolved >= edge, resolved)


def month_or(month: Column, default: int = 6) -> Column:
    """The month's number; the default where it is missing or no number."""
    return F.coalesce(month.try_cast("double").cast("int"), F.lit(default))


def calendar(d: Column) -> dict[str, Column]:
    """Year, month, quarter, and whether the month lies in 2020-03 to 2021-06, and in June to November."""
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "covid_period": in_months(d, (2020, 3), (2021, 6)),
        "hurricane_season": F.month(d).between(6, 11).cast("int"),
    }
