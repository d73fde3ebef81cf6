"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.scale import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table: A-Z to a-z, everything else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) drawn by hash, the same on every run."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) pairs: one row (node, root) per linked node, root the smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to the
    smallest one, then its smaller ones. Each is one aggregate with map-side minima and one join, and
    every round is written to the shared folder, so no neighbourhood is ever gathered in a cell. The
    number of rounds grows with the logarithm of the longest path.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return stage(pairs.groupBy("u").agg(F.min("v").alias("m")))

    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).select("u", F.least("u", "m").alias("m"))
        large = stage(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = minima(large)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(mark)


def roots(labels, left, right):
    """Labels of a small graph held in arrays (one task's share) after more edges: the smallest index reachable.

    labels is arange(n), or what an earlier call gave: edges may come in any number of parts. What an edge
    joins are the roots of its ends, so whatever hung on them before comes along.
    """
    import numpy as np

    labels = labels.copy()
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]
