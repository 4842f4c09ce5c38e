"""Line dedup by distinct-site spread (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, met

#: Boilerplate stands on at least so many sites.
MIN_SITES = 10
#: Spreads this near the threshold, as a share of it, are counted exactly; about 15 standard errors of the sketch.
BAND = 0.25
#: Boilerplate hashes up to this many (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def boilerplate_lines(docs: DataFrame, scratch: Scratch, min_sites: int, text_col: str, site_col: str) -> DataFrame:
    """(line, more): two hashes of each line that stands on at least min_sites distinct sites, in a scratch table.

    A HyperLogLog sketch of the sites per line, built on the map side and merged, settles lines far from
    the threshold; the sites of the others are counted exactly. Null sites count for no line.
    """
    lines = docs.select(
        col(site_col).cast("string").alias("site"), F.explode(F.split(col(text_col), "\n")).alias("line")
    ).where("line <> '' and site is not null")
    lines = lines.select(*line_key(F.col("line")), "site")
    spread = scratch.cut(
        lines.groupBy("line", "more")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", 12)).alias("sites"))
        .where(F.col("sites") >= int(min_sites * (1 - BAND)))
    )
    high = int(min_sites * (1 + BAND)) + 1
    near = spread.where(F.col("sites") < high).select("line", "more")
    exact = lines.distinct().join(near, ["line", "more"], "left_semi").groupBy("line", "more").count().where(F.col("count") >= min_sites)
    return scratch.cut(spread.where(F.col("sites") >= high).select("line", "more").unionByName(exact.select("line", "more")))


def line_key(line: Column) -> list[Column]:
    """Two hashes of a line with seeds of their own, so that no different lines share both."""
    return [F.xxhash64(line).alias("line"), F.xxhash64(F.lit("line"), line).alias("more")]


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    spare_copies: bool = False,
) -> DataFrame:
    """All input rows and columns, with kept_text, n_lines and n_removed.

    Lines end at newlines; empty ones count for nothing and stay. A line that stands on min_sites or more
    distinct sites goes from every document. spare_copies: a document that holds nothing else stays whole if its very text
    stands on several sites; then the document itself was copied, and a later document dedup keeps one.

    Null text: kept_text null, no lines. Empty text: kept whole. Very long texts are split whole, in one row's memory. Repeated
    rows are treated alike; ties don't arise. An empty table gives an empty result. Input columns named like a result
    column are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed")]
    base = docs.select(
        *[col(c).alias(f"__c{i}") for i, c in enumerate(keep)],
        col(text_col).alias("__text"),
        F.xxhash64(col(id_col), col(text_col)).alias("__row"),
        F.xxhash64(col(text_col)).alias("__hash"),
    )
    boiler = boilerplate_lines(docs, scratch, min_sites, text_col, site_col)
    if boiler.count() <= BROADCAST_ROWS:
        boiler = F.broadcast(boiler)
    lines = base.select("__row", "__hash", F.explode(F.array_distinct(F.split("__text", "\n"))).alias("line"))
    found = (
        lines.where("line <> ''")
        .select("__row", "__hash", *line_key(F.col("line")))
        .join(boiler, ["line", "more"], "left_semi")
        .groupBy("__row", "__hash")
        .agg(F.collect_set(F.struct("line", "more")).alias("__found"))  # at most the lines of one document
    )
    if spare_copies:
        sites = docs.select(F.xxhash64(col(text_col)).alias("__hash"), col(site_col).cast("string").alias("site"))
        copied = sites.groupBy("__hash").agg(F.min("site").alias("x"), F.max("site").alias("y"), F.count("*").alias("__n"))
        copied = scratch.cut(copied.where("x <> y").select("__hash", F.lit(True).alias("__copied"), "__n"))
        found = met(found, copied, ["__hash"], "__n", "left")
    # two rows with the same hashes but other texts would lose boilerplate only: __found holds nothing else
    whole = F.split("__text", "\n")
    left = F.filter(whole, lambda x: (x == "") | ~F.array_contains("__found", F.struct(*line_key(x))))
    out = base.join(found, ["__row", "__hash"], "left").withColumn(
        "__left", F.when(F.col("__found").isNull(), whole).otherwise(left)
    )
    if spare_copies:
        stays = F.col("__copied") & ~F.exists("__left", lambda x: x != "")
        out = out.withColumn("__left", F.when(stays, whole).otherwise(F.col("__left")))
    count = lambda xs: F.coalesce(F.size(F.filter(xs, lambda x: x != "")), F.lit(0)).cast("long")
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        F.array_join("__left", "\n").alias("kept_text"),
        F.when(F.col("__text").isNull(), 0).otherwise(count(whole)).cast("long").alias("n_lines"),
        F.when(F.col("__text").isNull(), 0).otherwise(count(whole) - count("__left")).cast("long").alias("n_removed"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.char_length("kept_text").cast("long").alias("kept_chars"),
        F.md5("kept_text").alias("kept_md5"),
    )


OP2_SQL = f"""
with w as (select row_number() over () as r, doc_id, source, text, string_split(text, chr(10)) as xs from documents),
l as (select r, source, unnest(xs) as line from w),
b as (select line from l where line <> '' and source is not null group by line having count(distinct source) >= {MIN_SITES}),
f as (select r, list(distinct l.line) as found from l join b using (line) group by r),
k as (select w.*, case when found is null then xs else list_filter(xs, lambda x: not list_contains(found, x)) end as kept from w left join f using (r)),
e as (select *, kept as left_over from k),
t as (select *, case when text is null then null when len(left_over) = 0 then '' else array_to_string(left_over, chr(10)) end as kept_text from e)
select doc_id, coalesce(len(list_filter(xs, lambda x: x <> '')), 0)::bigint as n_lines,
       coalesce(len(list_filter(xs, lambda x: x <> '')) - len(list_filter(left_over, lambda x: x <> '')), 0)::bigint as n_removed,
       length(kept_text)::bigint as kept_chars, md5(kept_text) as kept_md5
from t
"""
