"""Tables of run statistics: merged by header, with discordance columns joined on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Fixed order of the merged columns.
COLUMNS = "alg,setting,num-taxa,gene-trees,replicate,sb,spmin,spmax,rf-rate,optimal-quartet-score,running-time-s,max-cpu-mb,max-gpu-mb,gt-gt,gt-st".split(",")


def merge(spark: SparkSession, paths: list[str], discordance: DataFrame | None = None, on: tuple[str, ...] = ("num-taxa", "gene-trees", "replicate")) -> DataFrame:
    """The union of CSV files with different headers; missing columns are null. discordance: on, gt-gt, gt-st."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.csv(p, header=True) for p in paths])
    if discordance is not None:
        rows = rows.drop("gt-gt", "gt-st").join(discordance, list(on), "left")
    return rows.select(*[f"`{c}`" for c in COLUMNS if c in rows.columns])
