"""Thresholds, weights and the other fixed values the review depends on.

``Thresholds`` holds the defaults. A firm, or one ledger of it, can override any of them
through a DataFrame keyed by ``ledger_id`` (see ``threshold_frame``): the engine reads
thresholds as columns, so two ledgers with different limits run in one job.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "ledger_id"
VOUCHER = "voucher_id"
KEY = [LEDGER, VOUCHER]


@dataclass(frozen=True)
class Thresholds:
    """Review thresholds. Fixed values; amounts are in paise."""

    approval_limit_paise: int = 5_000_000
    threshold_band_paise: int = 500_000
    materiality_paise: int = 2_500_000
    round_step_paise: int = 1_000_000
    round_min_paise: int = 5_000_000
    routine_repeat_count: int = 3
    off_hours_start: int = 22
    off_hours_end: int = 6
    duplicate_window_days: int = 7
    period_end_window_days: int = 3
    rare_pair_max_count: int = 2
    rare_pair_max_share: float = 0.001
    rare_pair_max_flag_share: float = 0.10
    unfamiliar_preparer_max_share: float = 0.05
    unfamiliar_preparer_max_entries: int = 3
    dominant_owner_min_share: float = 0.50
    unfamiliar_preparer_min_account_entries: int = 8
    post_close_lag_days: int = 45
    amount_deviation_threshold: float = 6.0
    model_contamination: float = 0.02
    benford_min_sample: int = 100

    def __post_init__(self) -> None:
        if self.off_hours_end >= self.off_hours_start:
            raise ValueError("the off-hours window has to wrap past midnight")
        if self.approval_limit_paise <= self.threshold_band_paise:
            raise ValueError("the band below the approval limit is wider than the limit")

    def with_(self, **changes: float) -> Thresholds:
        return replace(self, **changes)


def threshold_type() -> T.StructType:
    kinds = {"int": T.LongType(), "float": T.DoubleType()}
    return T.StructType(
        [T.StructField(LEDGER, T.StringType(), False)]
        + [T.StructField(f.name, kinds[str(f.type)]) for f in fields(Thresholds)]
    )


def threshold_frame(spark: SparkSession, per_ledger: dict[str, Thresholds]) -> DataFrame:
    """One row per ledger with its own thresholds."""
    rows = [(ledger, *asdict(t).values()) for ledger, t in per_ledger.items()]
    return spark.createDataFrame(rows, threshold_type())


def threshold_problems(frame: DataFrame) -> DataFrame:
    """Rows of a threshold table that break a cross-field rule, with the rule broken."""
    wrap = F.when(F.col("off_hours_end") >= F.col("off_hours_start"), "off_hours_not_wrapping")
    band = F.when(
        F.col("approval_limit_paise") <= F.col("threshold_band_paise"), "band_wider_than_limit"
    )
    return (
        frame.select(LEDGER, F.explode(F.array_compact(F.array(wrap, band))).alias("problem"))
    )


def threshold_columns(default: Thresholds, overridden: bool) -> list[Column]:
    """Threshold columns named ``t_*``: the override when there is one, else the default."""
    out = []
    for f in fields(Thresholds):
        value = F.lit(getattr(default, f.name))
        if str(f.type) == "int":
            value = value.cast("bigint")
        out.append((F.coalesce(F.col(f.name), value) if overridden else value).alias("t_" + f.name))
    return out


# --- fixed values ------------------------------------------------------------

RULE_KINDS = [
    "duplicate_entry",
    "round_amount",
    "off_hours_posting",
    "weekend_posting",
    "period_end_concentration",
    "rare_account_pair",
    "threshold_adjacent",
    "missing_evidence",
    "unusual_preparer_account",
    "post_close_entry",
]
STATISTIC_KINDS = ["amount_outlier"]
MODEL_KINDS = ["ml_anomaly"]
ALL_KINDS = RULE_KINDS + STATISTIC_KINDS + MODEL_KINDS

SIGNAL_WEIGHTS = {
    "missing_evidence": 0.90,
    "duplicate_entry": 0.85,
    "period_end_concentration": 0.80,
    "post_close_entry": 0.75,
    "rare_account_pair": 0.70,
    "off_hours_posting": 0.65,
    "round_amount": 0.60,
    "unusual_preparer_account": 0.60,
    "weekend_posting": 0.50,
    "amount_outlier": 0.40,
    "threshold_adjacent": 0.35,
    "ml_anomaly": 0.15,
}
EVIDENCE_GAP_WEIGHT = 0.45
DOCUMENT_WEIGHT, APPROVAL_WEIGHT, NARRATION_WEIGHT = 0.55, 0.30, 0.15
HIGH_BAND, MEDIUM_BAND = 0.70, 0.40
MINOR_CONTRIBUTION, MEDIUM_CONTRIBUTION, HIGH_CONTRIBUTION = 0.05, 0.30, 0.60
BENFORD_CLOSE, BENFORD_ACCEPTABLE, BENFORD_MARGINAL = 0.006, 0.012, 0.015
MAX_ABS_PAISE = 1_000_000_000_000

#: Names of the built-in registry entries that say what a kind is called to a reader.
REVIEW_BUDGETS = [10, 25, 50, 100]
TUNING_LEDGERS = ["20250906", "1", "2", "3", "77", "999"]
