"""A corpus from documents: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of documents; extra columns of the input, of whatever name, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.common import Scratch, col
from monthloom.llm.op01_mix import mix_to_weights
from monthloom.llm.op02_lines import drop_boilerplate
from monthloom.llm.op05_quality import THRESHOLD, fit_quality, quality_score
from monthloom.llm.op08_minhash import drop_near_duplicates
from monthloom.llm.op10_pack import pack_best_fit

#: Several stages can't be written in SQL; the tests compare the rows with brute force.
ORACLE_SQL = None
#: Documents of at least this similarity (in percent) are near-duplicates.
NEAR_PERCENT = 80


#: Columns that the stages read; all others travel under other names, so that they clash with nothing.
READ = ("doc_id", "text", "source", "n_chars")


def _carried(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of docs, which it sees under names that no operator makes."""
    name = {c: c if c in READ else f"__carried{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[col(c).alias(n) for c, n in name.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in name.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled documents of the input.

    Null or empty texts have a score like others (the same for all of them). Long texts are scored whole. Equal
    texts, repeated rows among them, have equal scores. Without labels of both kinds the one there is decides, without
    any all stay. An empty table stays empty.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(spark, model, F.col("text")) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sources.

    Null text stays null, empty text empty; a text of nothing but such lines becomes empty unless the very text
    stands on several sources (near dedup sees to those). Null sources count for no line. Repeated rows are treated
    alike; ties don't arise. An empty table stays empty.
    """

    def stage(rows: DataFrame) -> DataFrame:
        cut = drop_boilerplate(rows, spare_copies=True)
        return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})

    return _carried(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null ids come last. Rows with one id and different texts are different documents; of rows equal in id and text
    one stays. Null, empty and wordless texts stay. Long texts are compared whole. An empty table stays empty.
    """
    return _carried(docs, lambda rows: drop_near_duplicates(rows, NEAR_PERCENT))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Documents without words are never taken. A null source is a source of its own. Repeated rows queue as separate
    documents; ties in the queue go by id, then size. An empty table stays empty.
    """

    def stage(rows: DataFrame) -> DataFrame:
        copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
        return mix_to_weights(rows).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))

    return _carried(docs, stage)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Null and empty texts are one piece of the closing 0. Long texts are cut. Null ids and repeated rows are documents
    like others; ties within a length go by id. An empty table gives no pieces. Other columns are not used.
    """
    return pack_best_fit(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
