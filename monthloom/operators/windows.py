"""Analytic operators over an entity's rows in month order.

All frames are positional. ``by`` and ``order`` name the entity and its order; callers that use several of
these in one select share one sort, since equal window specifications plan to one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.numeric import pct_change, ratio

START = Window.unboundedPreceding


def rows(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def lag0(c: str, k: int, w: WindowSpec) -> Column:
    """Value k rows before, 0 if there is none."""
    return F.coalesce(F.lag(c, k).over(w), F.lit(0))


def trailing(agg, c: Column | str, n: int, w: WindowSpec, lag: int = 1) -> Column:
    """agg over n rows, the last of them ``lag`` rows before the current one."""
    return agg(c).over(w.rowsBetween(-(n + lag - 1), -lag))


def change(c: str, k: int, w: WindowSpec) -> Column:
    return pct_change(F.col(c), F.lag(c, k).over(w))


def relative_change(c: str, near: int, far: int, w: WindowSpec) -> Column:
    a, b = F.lag(c, near).over(w), F.lag(c, far).over(w)
    return (a - b) / F.greatest(F.abs(b), F.lit(1))


def rolling_cv(c: str, n: int, w: WindowSpec, least: int = 2) -> Column:
    """Deviation over mean of the last n rows, the current one included; null below ``least`` values."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) >= least, ratio(F.stddev_samp(c).over(f), F.avg(c).over(f)))


def fill_forward(c: str, w: WindowSpec, limit: int | None = None) -> Column:
    """Last value at or before the row, at most ``limit`` rows old."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(START if limit is None else -limit, 0))


def rows_since(hit: Column, w: WindowSpec, none: int, inclusive: bool) -> Column:
    """Rows since the last hit, before the row (strict) or up to it (inclusive); ``none`` without one.

    Reads the row number __rn, see with_recency.
    """
    at = F.last(F.when(hit, F.col("__rn")), ignorenulls=True).over(w.rowsBetween(START, 0 if inclusive else -1))
    return F.coalesce(F.col("__rn") - at, F.lit(none))


def with_recency(df: DataFrame, hit: Column, by: list[str], order: list[str], name: str, none: int, inclusive: bool) -> DataFrame:
    w = rows(by, order)
    return df.withColumn("__rn", F.row_number().over(w)).withColumn(name, rows_since(hit, w, none, inclusive)).drop("__rn")


def leave_one_out(c: str, by: list[str]) -> Column:
    """Sum over the group without the row's own value."""
    return F.sum(c).over(Window.partitionBy(*by)) - F.col(c)


def with_distinct(df: DataFrame, c: str, by: list[str], name: str) -> DataFrame:
    """Distinct values of c in the row's group; a grouped count joined back, since distinct counts have no window."""
    return df.join(df.groupBy(*by).agg(F.countDistinct(c).alias(name)), by, "left")


def horizon_any(c: str, k: int, w: WindowSpec) -> Column:
    """Whether any of the next k rows is positive; null if fewer follow."""
    return F.when(F.lead(c, k).over(w).isNotNull(), (F.max(c).over(w.rowsBetween(1, k)) > 0).cast("int"))


def with_spells(df: DataFrame, state: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds starts (1 on the first row of a run of state 1), spell (number of the run so far) and rn."""
    w = rows(by, order)
    starts = ((F.col(state) == 1) & (lag0(state, 1, w) == 0)).cast("int")
    return df.withColumn("starts", starts).withColumns(
        {"rn": F.row_number().over(w), "spell": F.sum("starts").over(w.rowsBetween(START, 0))}
    )


def with_spell_memory(df: DataFrame, state: str, by: list[str], order: list[str]) -> DataFrame:
    """Durations of the runs of state 1 that ended before the row: last, mean and max, and rows since start and end.

    A run's duration stands on the first row after it; the memory of a row looks at earlier rows only.
    """
    w = rows(by, order)
    s = with_spells(df, state, by, order)
    first = F.max(F.when(F.col("starts") == 1, F.col("rn"))).over(w.rowsBetween(START, -1))
    ended = (F.col(state) == 0) & (lag0(state, 1, w) == 1)
    s = s.withColumn("ended", F.when(ended, F.col("rn") - first))
    before = w.rowsBetween(START, -1)
    since = lambda hit: F.coalesce(F.col("rn") - F.max(F.when(hit, F.col("rn"))).over(before), F.lit(999))
    zero = F.lit(0)
    s = s.withColumns(
        {
            "spell_last": F.coalesce(F.last("ended", ignorenulls=True).over(before), zero),
            "spell_mean": F.coalesce(F.avg("ended").over(before), F.lit(0.0)),
            "spell_max": F.coalesce(F.max("ended").over(before), zero),
            "since_onset": since(F.col("starts") == 1),
            "since_resolution": since(F.col("ended").isNotNull()),
        }
    )
    rebound = F.when(F.col("since_resolution") == 999, 0).otherwise(F.greatest(zero, 6 - F.col("since_resolution")))
    return s.withColumn("rebound", rebound)


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
