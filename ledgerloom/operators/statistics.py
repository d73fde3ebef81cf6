"""Robust amount statistics, first-digit conformity and the voucher feature table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER
from ledgerloom.functions import labels
from ledgerloom.operators.scale import amount_bucket, between, exact_quantiles, salted_join, stage

ACCOUNT = [LEDGER, "primary_account"]
#: Puts a median absolute deviation on the scale of a standard deviation. Fixed value.
MAD_SCALE = 0.6745

# Fixed order of the model's inputs.
FEATURES = [
    "log_amount",
    "line_count",
    "first_digit",
    "trailing_zeros",
    "is_round_thousand",
    "posting_hour",
    "has_posting_time",
    "day_of_week",
    "days_to_year_end",
    "posting_lag_days",
    "is_manual",
    "is_post_close",
    "has_evidence",
    "evidence_coverage",
    "has_approver",
    "account_pair_rarity",
    "preparer_familiarity",
    "amount_deviation",
]


def log_amount(amount: Column) -> Column:
    return F.log10(F.greatest(amount, F.lit(1)).cast("double"))


def amount_cells(vouchers: DataFrame) -> DataFrame:
    """Vouchers per (primary account, amount): what the amount statistics are computed from."""
    return vouchers.groupBy(*ACCOUNT, "amount_paise").agg(F.count(F.lit(1)).alias("w"))


def account_profile(vouchers: DataFrame) -> DataFrame:
    """Per primary debit account: entries, median, 10th and 90th percentile, all exact."""
    q = exact_quantiles(
        amount_cells(vouchers), ACCOUNT, "amount_paise", "w", amount_bucket(F.col("amount_paise")), [0.5, 0.1, 0.9]
    )
    middle = (log_amount(F.col("q0.lo")) + log_amount(F.col("q0.hi"))) / 2
    return q.select(
        *ACCOUNT,
        "n",
        between("q0").alias("median_paise"),
        between("q1").alias("low_paise"),
        between("q2").alias("high_paise"),
        middle.alias("log_median"),
    )


def account_amount_stats(vouchers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``account_profile``, and the same with the median absolute deviation of log10 amounts."""
    profile = stage(account_profile(vouchers))
    away = salted_join(
        amount_cells(vouchers), profile.select(*ACCOUNT, "n", "log_median"), ACCOUNT,
        weight="n", salt_by=["amount_paise"], how="inner",
    ).select(*ACCOUNT, "w", F.abs(log_amount(F.col("amount_paise")) - F.col("log_median")).alias("away"))
    spread = exact_quantiles(away, ACCOUNT, "away", "w", F.floor(F.col("away") * 8192).cast("bigint"), [0.5])
    mad = spread.select(*ACCOUNT, ((F.col("q0.lo") + F.col("q0.hi")) / 2).alias("mad"))
    return profile, profile.join(mad, ACCOUNT)


def deviation() -> Column:
    """Distance from the account's median in robust deviations; 0 when the account never varies."""
    unit = F.nullif(F.col("mad") / MAD_SCALE, F.lit(0.0))
    return F.coalesce(F.abs(log_amount(F.col("amount_paise")) - F.col("log_median")) / unit, F.lit(0.0))


def amount_deviation(vouchers: DataFrame) -> DataFrame:
    profile, stats = account_amount_stats(vouchers)
    return salted_join(vouchers, stats, ACCOUNT, weight="n", salt_by=["voucher_id"], sizes=profile).select(
        *KEY, "primary_account", "amount_paise", deviation().alias("deviation")
    )


def first_digit(amount: Column) -> Column:
    return F.substring(F.greatest(amount, F.lit(1)).cast("string"), 1, 1).cast("int")


def trailing_zeros(amount: Column) -> Column:
    text = F.abs(amount).cast("string")
    zeros = F.length(text) - F.length(F.rtrim(text, F.lit("0")))
    return F.when(amount == 0, 0).otherwise(F.least(zeros, F.lit(10)))


def benford(vouchers: DataFrame, times: DataFrame) -> DataFrame:
    """First-digit conformity per primary account with enough entries."""
    digits = (
        vouchers.where(F.col("primary_account") != "")
        .groupBy(*ACCOUNT, first_digit(F.col("amount_paise")).alias("digit"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shares = [
        F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)) / F.sum("n")
        for d in range(1, 10)
    ]
    gaps = [F.abs(s - math.log10(1 + 1 / d)) for d, s in enumerate(shares, start=1)]
    total = gaps[0]
    for gap in gaps[1:]:
        total = total + gap
    found = digits.groupBy(*ACCOUNT).agg(
        F.sum("n").alias("sample_size"), F.array(*shares).alias("observed"), F.round(total / 9, 6).alias("mad")
    )
    return (
        found.join(times.select(LEDGER, "t_benford_min_sample"), LEDGER)
        .where(F.col("sample_size") >= F.col("t_benford_min_sample"))
        .drop("t_benford_min_sample")
        .withColumn("conformity", labels.conformity(F.col("mad")))
    )


def flag(condition: Column) -> Column:
    return condition.cast("double")


def feature_columns() -> list[Column]:
    """The 18 model inputs over ``context("amounts", "pairs", "preparer")``."""
    timed = F.col("fidelity") == "date_and_time"
    lag = F.datediff(F.col("posted_at").cast("date"), F.col("voucher_date"))
    rarest = F.coalesce(F.col("rarest.times_seen"), F.lit(1))
    columns = {
        "log_amount": log_amount(F.col("amount_paise")),
        "line_count": F.col("line_count"),
        "first_digit": first_digit(F.col("amount_paise")),
        "trailing_zeros": trailing_zeros(F.col("amount_paise")),
        "is_round_thousand": flag(F.col("amount_paise") % 100_000 == 0),
        "posting_hour": F.when(timed, F.hour("posted_at")).otherwise(-1),
        "has_posting_time": flag(timed),
        "day_of_week": F.weekday("voucher_date"),
        "days_to_year_end": F.datediff("year_end", "voucher_date"),
        "posting_lag_days": lag,
        "is_manual": flag(F.col("is_manual")),
        "is_post_close": flag(F.col("is_post_close")),
        "has_evidence": flag(F.col("evidence_lines") > 0),
        "evidence_coverage": F.col("evidence_lines") / F.greatest(F.col("line_count"), F.lit(1)),
        "has_approver": flag(F.col("approved_by").isNotNull()),
        "account_pair_rarity": -F.log10(rarest / F.greatest(F.col("n_vouchers"), F.lit(1))),
        "preparer_familiarity": F.coalesce(F.col("familiarity"), F.lit(1.0)),
        "amount_deviation": deviation(),
    }
    return [F.coalesce(columns[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]


def voucher_features(frames) -> DataFrame:
    return frames.context("amounts", "pairs", "preparer").select(*KEY, "n_vouchers", *feature_columns())
