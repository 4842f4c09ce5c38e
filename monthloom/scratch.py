"""Tables that cut lineage, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables in the folder that the session's spark.checkpoint.dir names, so that a lost executor takes none away.

    Only where the setting is absent and all runs on one machine (tests) a temporary folder stands in.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="panel-scratch-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.base, self.made = f"{base.rstrip('/')}/{uuid.uuid4().hex}", 0

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
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in frames:
            path = jvm.org.apache.hadoop.fs.Path(f._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df itself if it was cut before, else read back from a table of its own."""
    return df if hasattr(df, "_scratch_path") else Scratch(df.sparkSession).cut(df)
