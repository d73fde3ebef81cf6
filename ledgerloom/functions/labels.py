"""Threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import config as C


def conformity(mad: Column) -> Column:
    return (
        F.when(mad <= C.BENFORD_CLOSE, "close")
        .when(mad <= C.BENFORD_ACCEPTABLE, "acceptable")
        .when(mad <= C.BENFORD_MARGINAL, "marginal")
        .otherwise("non-conforming")
    )


def contribution_level(share: Column) -> Column:
    return (
        F.when(share >= C.HIGH_CONTRIBUTION, "High")
        .when(share >= C.MEDIUM_CONTRIBUTION, "Medium")
        .otherwise("Low")
    )


def is_minor(share: Column) -> Column:
    return share < C.MINOR_CONTRIBUTION


def risk_band(priority: Column) -> Column:
    return F.when(priority >= C.HIGH_BAND, "high").when(priority >= C.MEDIUM_BAND, "medium").otherwise("low")


def readability(words_per_sentence: Column) -> Column:
    return (
        F.when(words_per_sentence <= 18, "easy").when(words_per_sentence <= 25, "fair").otherwise("heavy")
    )
