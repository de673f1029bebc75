"""Helpers shared by the text operators: table access, durable intermediate results, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.durable import durable, shared_dir  # noqa: F401

#: The separators of words in every contract: space and the control characters 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python functions get at most so many rows at once: texts may be long, and a worker holds a batch several times over.

    This is a setting of the caller's session and stays, as plans are lazy; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Intermediate tables as Parquet in the shared folder, compressed, which an operator drops when it is done with them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self._paths, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self._n += 1
        path = f"{self.folder}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of keep()."""
        jvm = self.spark._jvm
        for t in tables:
            _, path = self._paths.pop(id(t))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


    def only(self, *tables: DataFrame) -> None:
        """Deletes all tables of keep() but these."""
        kept = {id(t) for t in tables}
        self.drop(*[t for k, (t, _) in list(self._paths.items()) if k not in kept])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't use (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def body(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space as one space; single spaces are left as they are."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE_CLASS}]*|\x20[{SPACE_CLASS}]+", " ")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(spec: str) -> T.StructType:
    """A schema from "name type, ..."; unlike DDL text it needs no session, so modules can be imported by workers."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in spec.split(", "))])
