"""Written states of iterative jobs: every round is a Parquet table in a folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one for a local session, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir, or give a path, to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/siftwell-rounds/{uuid.uuid4().hex}"


class Rounds:
    """Tables below one folder.  A table that is complete is read instead of made again, so a job that died goes on where it was."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark)

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        at, fs = self._at(f"{name}/_SUCCESS")
        return fs.exists(at)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, written and read again; lineage ends here."""
        if not self.has(name):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def counted(self, name: str, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """``keep``, and how many rows there are (of which ``what`` holds): a number that arrives with the write."""
        n = F.count("*") if what is None else F.count_if(what)
        if self.has(name):
            kept = self.keep(name, df)
            return kept, kept.agg(n).first()[0]
        seen = Observation()
        return self.keep(name, df.observe(seen, n.alias("n"))), seen.get["n"]

    def drop(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)
