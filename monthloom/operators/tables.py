"""Aggregation, deduplication and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_by


def last_value(value: str, *order: str) -> Column:
    """Value that is not null at the greatest order."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def first_value(value: str, *order: str) -> Column:
    """Value that is not null at the smallest order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def roll_up(df: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """One pass of mixed aggregates, output name to expression."""
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in rules.items()])


def dominance(df: DataFrame, by: list[str], sub: str, item: str) -> DataFrame:
    """Largest sub-group's distinct items over all distinct items; two partial aggregates."""
    total = df.groupBy(*by).agg(F.countDistinct(item).alias("total"))
    top = df.groupBy(*by, sub).agg(F.countDistinct(item).alias("k")).groupBy(*by).agg(F.max("k").alias("top"))
    return top.join(total, by).select(*by, (F.col("top") / F.col("total")).alias("dominance"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nulls, rate) of each column in one scan."""
    one = df.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    long = one.unpivot("n", columns, "name", "nulls")
    return long.select("name", "nulls", (F.col("nulls") / F.col("n")).alias("rate"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        q.alias("q"),
    ).select("n", "mean", "std", "low", "high", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def binned(c: str, edges: list[float]) -> Column:
    """Number of the right-closed bin; null outside."""
    steps = list(zip(edges, edges[1:]))
    first = F.when((F.col(c) > steps[0][0]) & (F.col(c) <= steps[0][1]), 0)
    return reduce(lambda x, s: x.when((F.col(c) > s[1][0]) & (F.col(c) <= s[1][1]), s[0]), list(enumerate(steps))[1:], first)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; fails when a key repeats, at the latest when the result is read."""
    dup = duplicate_keys(df, keys).limit(1).agg(F.count("*").alias("__d"))
    ok = F.when(F.col("__d") > 0, F.raise_error(F.lit(f"repeated {keys}"))).otherwise(F.lit(True))
    return df.join(F.broadcast(dup), F.lit(True)).where(ok).drop("__d")


def dedup_keep_blank(df: DataFrame, ident: str, *order: Column) -> DataFrame:
    """One row per id; rows with a blank id all stay."""
    blank = F.coalesce(F.trim(F.col(ident)) == "", F.lit(True))
    return first_by(df.where(~blank), [ident], *order).unionByName(df.where(blank))


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in either, both, and one only."""
    j = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    has = lambda c: F.count(F.when(c, 1))
    A, B = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(has(A).alias("in_a"), has(B).alias("in_b"), has(A & B).alias("both"), has(A & ~B).alias("only_a"), has(B & ~A).alias("only_b"))


def panel_gate(df: DataFrame, by: list[str], month: str, state: str, least_entities: int = 10_000, least_months: int = 60) -> DataFrame:
    """One row: repeated keys, prevalence, entities, months, and issues, the list of what is wrong."""
    n = df.groupBy(*by, month).agg(F.count("*").alias("n"), F.sum(state).alias("s"))
    g = n.agg(
        F.sum(F.col("n") - 1).alias("repeated"),
        (F.sum("s") / F.sum("n")).alias("prevalence"),
        F.countDistinct(*by).alias("entities"),
        F.countDistinct(month).alias("months"),
    )
    checks = {
        "repeated keys": F.col("repeated") > 0,
        "prevalence above a half": F.col("prevalence") > 0.5,
        "no events": F.coalesce(F.col("prevalence"), F.lit(0.0)) == 0,
        "too few entities": F.col("entities") < least_entities,
        "too few months": F.col("months") < least_months,
    }
    return g.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))


def require_panel(df: DataFrame, by: list[str], month: str, state: str, **limits: int) -> None:
    """Fails with what panel_gate finds."""
    issues = panel_gate(df, by, month, state, **limits).first()["issues"]
    if issues:
        raise ValueError("panel gate: " + "; ".join(issues))


def completeness(df: DataFrame, panel: DataFrame, by: str, month: str, code: str, form: str, metrics: list[str], first: int, last: int) -> DataFrame:
    """One row on a source: missing months of first..last, extent, repeated keys, codes not of the form, nulls, overlap with a panel's keys."""
    keys = df.groupBy(by, month).agg(
        F.count("*").alias("n"),
        F.sum((~F.coalesce(F.col(code).rlike(form), F.lit(False))).cast("int")).alias("bad"),
        *[F.sum(F.col(m).isNull().cast("int")).alias(f"__{m}") for m in metrics],
    )
    out = keys.agg(
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
        F.countDistinct(month).alias("months"),
        F.countDistinct(F.when(F.col(month).between(first, last), F.col(month))).alias("__have"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.sum("bad").alias("bad_keys"),
        *[F.sum(f"__{m}").alias(f"{m}_missing") for m in metrics],
    )
    ours, theirs = keys.select(by, F.lit(1).alias("a")).distinct(), panel.select(by, F.lit(1).alias("b")).distinct()
    both = ours.join(theirs, by, "full").agg(
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("in_panel"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("not_in_panel"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("panel_only"),
    )
    return out.join(F.broadcast(both), F.lit(True)).withColumn("missing_months", F.lit(last - first + 1) - F.col("__have")).drop("__have")
