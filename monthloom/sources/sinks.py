"""Outputs of a stage."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, replaced whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def report(df: DataFrame, path: str, compressed: bool = True) -> None:
    """A small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, compression="gzip" if compressed else "none")


def metadata(spark: SparkSession, values: dict, path: str) -> None:
    """Run metadata as a JSON text file in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, build, stamp: str) -> DataFrame:
    """The table at path if it was built from inputs with the same stamp, else built and written anew."""
    key = f"{path}.stamp"
    try:
        fresh = spark.read.text(key).first()["value"] == stamp
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = False
    if not fresh:
        table(build(), path)
        spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(key)
    return spark.read.parquet(path)


def inputs_stamp(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the path, length and time of every file below the paths (or patterns), as their store tells them; nothing is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(conf)
        for top in store.globStatus(path) or []:
            files = store.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(json.dumps(sorted(seen)).encode()).hexdigest()


def cached_from(spark: SparkSession, path: str, build, inputs: list[str]) -> DataFrame:
    """The table at path as long as no input is newer, gone or added, else built and written anew."""
    return cached(spark, path, build, inputs_stamp(spark, inputs))
