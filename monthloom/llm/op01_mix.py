"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, col, word_count

#: Rows of a slice of one source's queue, at most about.
ROWS_PER_SLICE = 100_000


def source_targets(by_source: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Words to take from each source.

    by_source: (__null int, __src string, source_size long), one row per source. Sources in code point
    order, null last, weigh ``weights`` in turn. Together they take the words of all sources; no source
    takes over ``max_repeats`` times its own, and the excess goes to the others by weight. Sources are
    filled in ascending order of cap / weight: one is capped while the share per weight that is left
    reaches its cap. One row per source, so the windows over all sources stay small.
    """
    ranked = Window.orderBy("__null", "__src")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ranked) - 1) % len(weights) + 1)
    s = by_source.withColumn("__w", turn).withColumn("__cap", (F.col("source_size") * max_repeats).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__null", "__src").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    s = s.withColumn(
        "__share",
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("__cap").over(before), zero))
        / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), zero)),
    )
    capped = F.col("__share") * F.col("__w") >= F.col("__cap")
    level = F.max(F.when(~capped, F.col("__share"))).over(everything)
    return s.withColumn("target", F.when(capped, F.col("__cap")).otherwise(level * F.col("__w"))).select(
        "__null", "__src", "source_size", "target"
    )


def _queued(docs: DataFrame, slices: DataFrame) -> DataFrame:
    """Each document with __cum: words of its source up to and with it, in shuffled order."""
    in_slice = (
        Window.partitionBy("__null", "__src", "__slice")
        .orderBy("__key", "__id", "__size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return docs.join(slices, ["__null", "__src", "__slice"]).withColumn(
        "__cum", F.col("__before") + F.sum("__size").over(in_slice)
    )


def mix_to_weights(
    docs: DataFrame,
    weights=(5, 2, 1),
    max_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """All input columns and rows, with size, source_size, target and taken (words the mix takes).

    Documents of a source queue in the order of md5(seed:id), and again for each further repeat.
    A place in the queue has the virtual finish time (words of the source so far) / target; all places
    are ordered by it over all sources and taken while their words fit the budget, the words of all
    sources. Places with a finish time of at most 1 always fit. The order is cut without one task that
    sees it all: queues are summed by slices of the key, finish times by equal ranges of virtual time
    (each holds about as many words), and only the range in which the budget ends is sorted.

    Null or empty text: size 0, takes nothing. Null source: a source of its own, last. Null ids queue
    first in their slice. Repeated rows are separate documents. An empty table gives an empty result.
    Input columns named like a result column are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    made = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in made]
    sized = docs.select(
        *[col(c).alias(f"__c{i}") for i, c in enumerate(keep)],
        word_count(col(text_col)).alias("__size"),
        col(source_col).isNull().cast("int").alias("__null"),
        F.coalesce(col(source_col), F.lit("")).alias("__src"),
        col(id_col).alias("__id"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit("")))).alias("__key"),
    )
    slim = scratch.cut(sized.select("__size", "__null", "__src", "__id", "__key"))
    budget, n = slim.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    # 4096 slices of a source's queue, and so many more that a source of all rows has about ROWS_PER_SLICE in each
    digits = max(3, math.ceil(math.log(max(n, 1) / ROWS_PER_SLICE, 16)))
    slice_ = F.conv(F.substring("__key", 1, digits), 16, 10).cast("long")
    sized, slim = sized.withColumn("__slice", slice_), slim.withColumn("__slice", slice_)
    by_slice = slim.groupBy("__null", "__src", "__slice").agg(F.sum("__size").alias("__words"))
    slices = scratch.cut(
        by_slice.withColumn(
            "__before",
            F.coalesce(
                F.sum("__words").over(
                    Window.partitionBy("__null", "__src").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    targets = source_targets(
        slices.groupBy("__null", "__src").agg(F.sum("__words").alias("source_size")), weights, max_repeats
    )
    slices = scratch.cut(slices.join(targets, ["__null", "__src"]).drop("__words"))
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("__cum")).cast("double") / F.col("target")
    places = (
        _queued(slim.where("__size > 0"), slices)
        .select("__null", "__src", "__key", "__id", "__size", F.explode(F.array(*[finish(e) for e in range(max_repeats)])).alias("__f"))
    )
    ranges = max(1024, n // 20_000)
    at = F.when(F.col("__f") < 1, F.floor(F.col("__f") * ranges)).otherwise(ranges + F.floor(F.log2("__f") * ranges))
    places = scratch.cut(places.withColumn("__range", at.cast("long")))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        places.groupBy("__range")
        .agg(F.sum("__size").alias("__words"))
        .withColumn("__end", F.sum("__words").over(upto))
        .where(F.col("__end") > budget)
        .agg(F.min(F.struct("__range", "__end", "__words")).alias("x"))
        .select("x.*")
        .first()
    )
    order = ["__f", "__null", "__src", "__key", "__id", "__size"]
    if last is None or last["__range"] is None:  # the budget covers every place
        within = lambda f: F.lit(True)
    else:
        cum = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = (
            places.where(F.col("__range") == last["__range"])
            .withColumn("__end", cum + (last["__end"] - last["__words"]))
            .where(F.col("__end") > budget)
            .agg(F.min(F.struct(*order)).alias("x"))
            .first()["x"]
        )
        kinds = dict(places.dtypes)
        first_out = F.struct(*[F.lit(edge[c]).cast(kinds[c]).alias(c) for c in order])
        within = lambda f: F.struct(f.alias("__f"), *order[1:]) < first_out
    taken = sum((F.when(within(finish(e)), F.col("__size")).otherwise(F.lit(0)) for e in range(max_repeats)), F.lit(0))
    scratch.drop(places)
    # documents without words queue too, so that all rows pass one join; they take nothing
    out = _queued(sized, slices)
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__size").alias("size"),
        "source_size",
        "target",
        F.when(F.col("__size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_to_weights(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The queue in one piece, for the comparison on small tables.
OP1_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size,
             [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
c as (select *, 3.0::double * source_size as cap from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over p, 0)) / (sum(w) over () - coalesce(sum(w) over p, 0)) as share
      from c window p as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when share * w >= cap then cap
        else max(case when share * w < cap then share end) over () * w end as target from l),
q as (select d.*, t.source_size, t.target,
             (sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and current row))::bigint as cum
      from d join t on d.source is not distinct from t.source),
f as (select q.*, ((e.e * source_size + cum)::double / target) as vf from q cross join (select unnest([0, 1, 2]) as e) e where size > 0),
g as (select *, sum(size) over (order by vf, source nulls last, k, doc_id, size rows between unbounded preceding and current row) as upto from f),
k as (select source, k, doc_id, size, cum, count(*) as n from g where upto <= (select sum(size) from d) group by all)
select q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.n, 0))::bigint as taken
from q left join k on q.source is not distinct from k.source and q.doc_id is not distinct from k.doc_id and q.cum = k.cum and q.size = k.size
"""
