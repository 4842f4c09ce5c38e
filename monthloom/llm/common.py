"""Shared helpers of the corpus operators: scratch tables, row identity, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows that go to a Python worker at once, at most; each holds a whole text.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, so that neither side of the transfer holds more texts than that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables that cut lineage, in the shared folder that the session's spark.checkpoint.dir names.

    They are written as Parquet, so every executor can read them after the one that wrote them is lost.
    Only where the setting is absent and all runs on one machine (tests) a temporary folder stands in.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="corpus-scratch-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.base = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.made = 0

    def path(self) -> str:
        """A path of its own for another table."""
        self.made += 1
        return f"{self.base}/{self.made - 1}"

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a table written once."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A row that more rows than this meet in a join is broadcast instead; more where partitions are larger anyway.
HEAVY = 4000


def met(left: DataFrame, right: DataFrame, on: list[str], times: str, how: str = "inner") -> DataFrame:
    """left joined with right (one row per key, in a scratch table) where single keys may hold any share of left.

    times: a column of right that says how many rows of left have its key; it is not in the result. Rows of right
    over a limit are broadcast, so no task meets all their partners. They are at most 8 for each shuffle partition, since
    the limit grows with the sum of times.
    """
    total, most = right.agg(F.coalesce(F.sum(times), F.lit(0)), F.coalesce(F.max(times), F.lit(0))).first()
    limit = max(HEAVY, total // (8 * partitions(left.sparkSession)))
    if most <= limit:
        return left.join(right.drop(times), on, how)
    heavy = right.where(F.col(times) > limit)
    light, few = right.where(F.col(times) <= limit).drop(times), F.broadcast(heavy.drop(times))
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return rest if how == "left_anti" else rest.unionByName(left.join(few, on, "inner" if how == "left" else how))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    edges: (a, b), non-null, of one orderable type. Returns (node, component), one row per node that
    has an edge to another node. Alternates large-star and small-star rounds: every node links its
    larger neighbours, then itself and its smaller ones, to the smallest node it sees. Rounds are
    few (logarithmic in practice); each is written to scratch. A hub's links meet in one minimum,
    which is a partial aggregate, so no task collects a hub's neighbours.
    """
    now = scratch.cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node goes to the smallest of the node and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = scratch.cut(small.where("a > b").distinct())
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            scratch.drop(now)
            now = after
            break
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return labels.unionByName(roots)
