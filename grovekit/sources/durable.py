"""Results that are read several times, written once where all executors can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir; only a local session without it gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="grovekit-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so plans stay small and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop as Parquet in the shared folder: a round's plan begins at files, and doesn't carry what earlier rounds knew."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
