"""Dense month spines, shifts by publication lag, and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def months(df: DataFrame, month: str = "ym") -> DataFrame:
    """All month indexes from the table's first to its last."""
    return densify(df, [], month)


def densify(df: DataFrame, by: list[str], month: str = "ym", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """All months of each entity between its first and last observation, clipped to [first, last].

    Entities whose window lies outside the clip are dropped before it is applied.
    """
    w = df.groupBy(*by).agg(F.min(month).alias("__a"), F.max(month).alias("__b"))
    if first is not None:
        w = w.where((F.col("__b") >= first) & (F.col("__a") <= last))
        w = w.withColumns({"__a": F.greatest("__a", first), "__b": F.least("__b", last)})
    return w.select(*by, F.explode(F.sequence("__a", "__b")).alias(month))


def spread_forward(df: DataFrame, month: str, n: int, start: int = 1) -> DataFrame:
    """Each row in the months start .. start+n-1 after its own: an equi-join form of trailing event windows."""
    return df.withColumn(month, F.explode(F.sequence(F.col(month) + start, F.col(month) + (start + n - 1))))


def expand_interval(df: DataFrame, start: str, end: str, month: str = "ym") -> DataFrame:
    """One row per month that the closed interval of month indexes touches."""
    return df.where(F.col(end) >= F.col(start)).withColumn(month, F.explode(F.sequence(start, end)))


def quarter_to_months(df: DataFrame, quarter: str, lag: int, month: str = "ym") -> DataFrame:
    """A quarter index (year*4 + quarter - 1), published ``lag`` quarters later, as its three months."""
    q = F.col(quarter) + lag
    return df.withColumn(month, F.explode(F.sequence(q * 3, q * 3 + 2)))


def year_to_months(df: DataFrame, year: str, lag: int, month: str = "ym") -> DataFrame:
    y = F.col(year) + lag
    return df.withColumn(month, F.explode(F.sequence(y * 12, y * 12 + 11)))


def arrows(s: Column) -> Column:
    """Targets of a list such as '2019->2020; 2021->2022'."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"->\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def fill_missing(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """<c>_missing flags, then the fill."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in fills}
    return df.withColumns(flags).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})


def backfill(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Columns of a feature table that has no row here, from what the spine itself tells."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in derived.items()})


def group_totals(df: DataFrame, seen: DataFrame, group: list[str], volume: str, missing: Column) -> DataFrame:
    """Rows of groups that were seen: own volume (0 where missing), the group's largest as group_<volume>, imputed 1 where missing."""
    top = seen.groupBy(*group).agg(F.max(volume).alias(f"group_{volume}"))
    return df.join(top, group).withColumns({volume: F.when(missing, F.lit(0)).otherwise(F.col(volume)), "imputed": missing.cast("int")})
