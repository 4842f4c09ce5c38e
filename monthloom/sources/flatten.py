"""Nested JSON records as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, schema: str, name: str = "j") -> DataFrame:
    return df.withColumn(name, F.from_json(text, schema))


def joined(items: Column, sep: str = " | ") -> Column:
    """List fields as one text."""
    return F.array_join(items, sep)


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def versions(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A map of versions as rows (version, value)."""
    return df.select(*keep, F.explode(column).alias("version", "value"))
