"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes what
a stage returns to the shared folder and reads it again for the next. All but the last return the columns
of documents. Mixing returns a document as often as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import line_dedup, mixing, packing, simhash, toxicity
from ledgerloom.llm.common import table
from ledgerloom.operators.scale import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Two stages hold a trained network and a random draw, one a hash that SQL lacks: tests compare with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
