"""Sharding by sampled splitters."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, col

#: Sampled keys per range, on average; the sample held by the driver is about this times the ranges.
KEYS_PER_RANGE = 32
#: Rows a range should hold, and the fewest and most ranges.
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES = 20_000, 64, 50_000
#: A range over this many times its share is subdivided.
OVERFULL = 2.0
#: Most turns of subdivision.
MAX_TURNS = 48
#: Equal texts stay in one shard while together they have at most this share of a shard.
GROUP_SHARE = 0.05


def _placed(rows: DataFrame, high: np.ndarray, low: np.ndarray) -> DataFrame:
    """rows with __range: how many of the splitters (sorted pairs) are at or below (__h, __d)."""

    def at(h: pd.Series, d: pd.Series) -> pd.Series:
        h, d = h.to_numpy(), d.to_numpy()
        first, last = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        while True:  # binary search among the splitters of the same __h
            open_ = first < last
            if not open_.any():
                return pd.Series(first)
            mid = np.where(open_, (first + last) // 2, 0)
            below = open_ & (low[mid] <= d)
            first, last = np.where(below, mid + 1, first), np.where(open_ & ~below, mid, last)

    return rows.withColumn("__range", F.pandas_udf(at, "long")("__h", "__d"))


def _drawn(rows: DataFrame, per_byte: float, turn: int) -> list[tuple[int, int]]:
    """Keys of a sample in which each row is as likely as its size; the same rows on every run."""
    dice = F.pmod(F.xxhash64("__h", "__d", F.lit(turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [tuple(x) for x in rows.where(dice < F.col("__size") * F.lit(per_byte)).select("__h", "__d").collect()]


def shard_by_splitters(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All input rows and columns, with size, text_crc32, shard and slot.

    Law: shards have near equal bytes. Rows are ordered by (hash of text, hash of id and text). A
    size-weighted sample of these keys gives quantile splitters; the ranges between are measured over all
    rows, and overfull ones are split again by a denser sample of their own. Exact sums over ranges, then
    within each range, give every row its place in the total of bytes; the place decides the shard. Equal
    texts stay together while they have at most GROUP_SHARE of a shard; larger groups are divided.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, CRC of no bytes). Null ids sort by their text.
    Repeated rows are separate rows. An empty table gives an empty result. Input columns named like a
    result column are replaced. The driver holds a sample and the splitters, both bounded by MAX_RANGES.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(
        *[col(c).alias(f"__c{i}") for i, c in enumerate(keep)],
        (F.octet_length(text).cast("long") + 1).alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        F.xxhash64(text).alias("__h"),
        F.xxhash64(col(id_col), text, F.lit("id")).alias("__d"),
    )
    slim = scratch.cut(rows.select("__size", "__h", "__d"))
    total, n = slim.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    ranges = min(MAX_RANGES, max(MIN_RANGES, n // ROWS_PER_RANGE))
    splitters: list[tuple[int, int]] = []
    per_byte, sizes, over = KEYS_PER_RANGE * ranges / max(total, 1), {}, None
    for turn in range(MAX_TURNS):
        drawn = sorted(set(_drawn(slim if over is None else over, per_byte, turn)))
        if over is None:
            picked = drawn[KEYS_PER_RANGE // 2 :: KEYS_PER_RANGE]
        else:
            picked = drawn[1::2]
        # a range begins with a whole group of equal texts unless the group is large enough to be drawn twice
        times = Counter(h for h, _ in drawn)
        splitters = sorted({*splitters, *((h, d if times[h] > 1 else -(1 << 63)) for h, d in picked)})
        high, low = (np.array([k[i] for k in splitters], "i8") for i in (0, 1))
        placed = _placed(slim, high, low)
        sizes = {
            r["__range"]: (r["b"], r["n"], r["one"])
            for r in placed.groupBy("__range")
            .agg(F.sum("__size").alias("b"), F.count("*").alias("n"), (F.min("__d") == F.max("__d")).alias("one"))
            .collect()
        }
        full = [r for r, (b, k, one) in sizes.items() if b > OVERFULL * total / ranges and k > 1 and not one]
        if not full:
            break
        if turn == MAX_TURNS - 1:
            raise RuntimeError("ranges stay overfull")  # each turn draws twice as densely, until it draws every key
        over, per_byte = placed.where(F.col("__range").isin(full)).select("__size", "__h", "__d"), per_byte * 2
    starts, bytes_, count = [], 0, 0
    for r in sorted(sizes):
        starts.append((r, bytes_, count))
        bytes_, count = bytes_ + sizes[r][0], count + sizes[r][1]
    starts = spark.createDataFrame(starts, "__range long, __bytes long, __rows long")
    order = Window.partitionBy("__range").orderBy("__h", "__d", "__size")
    group = Window.partitionBy("__range", "__h")
    share = max(total, 1) / shards
    out = (
        _placed(rows, high, low)
        .join(F.broadcast(starts), "__range")
        .withColumn("__at", F.row_number().over(order) - 1 + F.col("__rows"))
        .withColumn("__end", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__bytes"))
        .withColumn("__group", F.sum("__size").over(group))
        .withColumn("__first", F.min(F.col("__end") - F.col("__size")).over(group))
    )
    middle = F.when(
        F.col("__group") <= GROUP_SHARE * share, F.col("__first") + F.col("__group") / 2
    ).otherwise(F.col("__end") - F.col("__size") / 2)
    out = out.withColumn("__shard", F.least(F.floor(middle / F.lit(share)), F.lit(shards - 1)).cast("int"))
    # a shard's first row: the rows of all shards before it, at most ``shards`` numbers
    firsts = out.groupBy("__shard").agg(F.min("__at").alias("__start"))
    return out.join(F.broadcast(firsts), "__shard").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__at") - F.col("__start")).cast("long").alias("slot"),
    )


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_splitters(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
