"""Ledger lines to a ranked review queue: the whole pipeline as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import MODEL_KINDS, RULE_KINDS, STATISTIC_KINDS, Thresholds
from ledgerloom.operators.fusion import findings, queue
from ledgerloom.operators.signals import run_signals
from ledgerloom.operators.vouchers import LedgerFrames


#: Everything the built-in row signals need, as ``run_signals`` asks for it.
EVERYTHING = ("amounts", "pairs", "preparer")


def all_hits(
    frames: LedgerFrames, *, use_model: bool = True, drop_signals: Iterable[str] = (), detail: bool = True
) -> DataFrame:
    kinds = [*RULE_KINDS, *STATISTIC_KINDS, *(MODEL_KINDS if use_model else [])]
    return run_signals(frames, [k for k in kinds if k not in set(drop_signals)], detail=detail)


def build_findings(
    lines: DataFrame | LedgerFrames,
    thresholds: Thresholds | None = None,
    overrides: DataFrame | None = None,
    *,
    use_evidence: bool = True,
    use_model: bool = True,
    drop_signals: Iterable[str] = (),
) -> DataFrame:
    """The ranked queue of every ledger in ``lines``: one row per finding with its ``rank``."""
    frames = lines if isinstance(lines, LedgerFrames) else LedgerFrames(lines, thresholds, overrides)
    frames.keep_context(*EVERYTHING)
    hits = all_hits(frames, use_model=use_model, drop_signals=drop_signals, detail=False)
    return queue(findings(hits, frames.context(*EVERYTHING), use_evidence=use_evidence))


def top_of_queue(ranked_queue: DataFrame, n: int) -> DataFrame:
    """The first ``n`` findings of each ledger: a report, so the limit is the point of it."""
    return ranked_queue.where(F.col("rank") <= n)
