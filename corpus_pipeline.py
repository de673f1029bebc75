"""The corpus pipeline: rules, exact copies, near copies, mixing, packing. Each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm.common import Scratch, table
from grovekit.llm.exact_dedup import drop_copies
from grovekit.llm.mixing import mixed_documents
from grovekit.llm.ngram_join import Join, one_of_each
from grovekit.llm.packing import pack
from grovekit.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned one go. Null and empty texts fail it; repeated rows go or stay together. Other columns stay as they are; an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, that with the smallest doc_id; null texts count as empty ones, and of repeated rows one stays. Other columns stay as they are; an empty table stays empty."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five words, one stays, that with the smallest doc_id. Texts without words are linked with nothing; of repeated rows one stays. Other columns stay as they are; an empty table stays empty."""
    return one_of_each(docs, Join(words=5, num=80))


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come several times; none is lost. A null source is a source of its own; repeated rows come each. Other columns stay as they are; an empty table stays empty."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is its closing id; repeated rows are packed each. Other columns are left out; an empty table gives none."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("temperature_mixing", temperature_mixing),
    ("packing", packing),
]

#: SQL can express neither the learned rules nor the packing; tests hold every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Empty tables give an empty result; what a stage wrote is deleted once the next has ended."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
