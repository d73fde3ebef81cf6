"""Line rules, balance rules and decision rules as columns; bad rows never stop a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER
from ledgerloom.functions import dates
from ledgerloom.operators.scale import ranked
from ledgerloom.schema import ACCOUNT_GROUPS, TIME_FIDELITIES, VOUCHER_TYPES

REQUIRED_TEXT = ["line_id", "voucher_id", "entity_id", "account_code", "account_name", "created_by"]


def line_rules() -> dict[str, Column]:
    """Rule name to the condition under which a line breaks it."""
    c = F.col
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    debit, credit = c("debit_paise"), c("credit_paise")
    return {
        **{f"{n}_empty": no(F.length(n) >= 1) for n in REQUIRED_TEXT},
        "line_number_below_one": no(c("line_number") >= 1),
        "fiscal_year_shape": no(c("fiscal_year").rlike(r"^FY\d{4}-\d{2}$")),
        "period_out_of_range": no(c("period").between(1, 12)),
        "voucher_date_missing": c("voucher_date").isNull(),
        "time_fidelity_unknown": no(c("time_fidelity").isin(*TIME_FIDELITIES)),
        "voucher_type_unknown": no(c("voucher_type").isin(*VOUCHER_TYPES)),
        "account_group_unknown": no(c("account_group").isin(*ACCOUNT_GROUPS)),
        "negative_amount": no((debit >= 0) & (credit >= 0)),
        "currency_shape": no(c("currency").rlike(r"^[A-Z]{3}$")),
        "not_one_sided": no((debit != 0) != (credit != 0)),
        "fiscal_year_of_date": c("fiscal_year") != dates.fiscal_year(c("voucher_date")),
        "period_of_date": c("period") != dates.fiscal_period(c("voucher_date")),
    }


def check_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``problems``: the names of the rules each breaks, empty when accepted."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in line_rules().items()]
    return lines.withColumn("problems", F.array_compact(F.array(*broken)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("problems") == 0).drop("problems")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("problems") > 0)


def error_report(checked: DataFrame, limit: int | None = None) -> DataFrame:
    """The rejected rows of each ledger for a person to read: all, or the first ``limit``."""
    rows = rejected(checked).withColumn("row", F.coalesce(F.col("source_row"), F.col("line_number").cast("bigint")))
    if limit is not None:
        rows = ranked(rows, [LEDGER], ["row", "line_id"], "n").where(F.col("n") <= limit)
    return rows.select(
        LEDGER, "row", "line_id", F.array_join("problems", "; ").alias("reason")
    )


def voucher_gaps(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*KEY).agg(F.sum(F.col("debit_paise") - F.col("credit_paise")).alias("gap_paise"))


def unbalanced(lines: DataFrame) -> DataFrame:
    return voucher_gaps(lines).where(F.col("gap_paise") != 0)


def balanced_lines(lines: DataFrame) -> DataFrame:
    return lines.join(unbalanced(lines), KEY, "left_anti")


def ingest_summary(checked: DataFrame) -> DataFrame:
    """Per ledger: lines accepted and rejected, vouchers that do not balance."""
    counts = checked.groupBy(LEDGER).agg(
        F.count_if(F.size("problems") == 0).alias("accepted"), F.count_if(F.size("problems") > 0).alias("rejected")
    )
    gaps = unbalanced(accepted(checked)).groupBy(LEDGER).agg(F.count(F.lit(1)).alias("unbalanced"))
    return counts.join(gaps, LEDGER, "left").withColumn("unbalanced", F.coalesce("unbalanced", F.lit(0)))


# Fixed values.
ACTIONS = ["accept", "reject", "investigate", "adjust"]
CLOSING_ACTIONS = ["accept", "reject"]
MIN_NOTE_WORDS = 3


def decision_problem() -> Column:
    """Why a decision row may not be recorded, or null."""
    note = F.trim(F.coalesce(F.col("note"), F.lit("")))
    words = F.when(note == "", 0).otherwise(F.size(F.split(note, r"\s+")))
    return (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action")
        .when((F.col("action") == "reject") & (words < MIN_NOTE_WORDS), "rejection_without_reason")
        .when((F.col("action") == "adjust") & F.col("adjusted_band").isNull(), "adjustment_without_band")
        .when(F.coalesce(F.length("reviewer"), F.lit(0)) < 1, "no_reviewer")
    )
