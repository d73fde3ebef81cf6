"""Trial balance, ratios and monthly movements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LEDGER

CASH_LIMIT_PAISE = 1_000_000
DUES_SHARE = 0.10


@dataclass(frozen=True)
class AccountRoles:
    """Which accounts of a book play which part; prefixes of the account code."""

    sales: str = "4000"
    purchases: str = "5000"
    debtors: str = "1100"
    creditors: str = "2000"
    cash: str = "1000"
    dues: list[str] = field(default_factory=lambda: ["2202", "2200", "2201", "2100", "2101", "2310", "2300"])
    output_tax: list[str] = field(default_factory=lambda: ["2100", "2101"])
    input_tax: list[str] = field(default_factory=lambda: ["1300", "1301"])


def trial_balance(lines: DataFrame) -> DataFrame:
    """Closing balance per account; the balances of a ledger sum to zero."""
    return lines.groupBy(LEDGER, "account_code").agg(
        F.sum("debit_paise").alias("debit_paise"),
        F.sum("credit_paise").alias("credit_paise"),
        F.sum(F.col("debit_paise") - F.col("credit_paise")).alias("balance_paise"),
    )


def ledger_ratios(balances: DataFrame, lines: DataFrame, roles: AccountRoles) -> DataFrame:
    """Per ledger: debtor and creditor days, gross margin, dues check and cash-payment check."""
    held = lambda prefix: F.coalesce(
        F.sum(F.when(F.col("account_code").startswith(prefix), F.col("balance_paise"))), F.lit(0)
    )
    sales = -held(roles.sales)
    due = F.lit(True)
    for code in roles.dues:
        due = due & (F.abs(held(code)) < sales * DUES_SHARE)
    days = lambda stock, flow: F.round(stock / F.nullif(flow, F.lit(0)) * 365, 4)
    base = balances.groupBy(LEDGER).agg(
        days(held(roles.debtors), sales).alias("debtor_days"),
        days(F.abs(held(roles.creditors)), held(roles.purchases)).alias("creditor_days"),
        F.round(1 - held(roles.purchases) / F.nullif(sales, F.lit(0)), 4).alias("gross_margin"),
        due.alias("dues_within_share"),
    )
    cash = lines.where(F.col("account_code").startswith(roles.cash) & (F.col("credit_paise") > 0))
    paid = cash.groupBy(LEDGER).agg(F.count_if(F.col("credit_paise") > CASH_LIMIT_PAISE).alias("cash_over_limit"))
    return base.join(paid, LEDGER, "left").withColumn("cash_over_limit", F.coalesce("cash_over_limit", F.lit(0)))


def monthly_movement(lines: DataFrame) -> DataFrame:
    """Net credit per account and calendar month, with the month it falls due."""
    month = F.trunc("voucher_date", "month").alias("month")
    return (
        lines.groupBy(LEDGER, "account_code", month)
        .agg(F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("net_credit_paise"))
        .withColumn("due_month", F.add_months("month", 1).cast("date"))
    )


def tax_set_off(movement: DataFrame, roles: AccountRoles) -> DataFrame:
    """Per month: output tax, input credit and what is left to pay when both rules hold."""
    held = lambda codes: F.coalesce(
        F.sum(F.when(F.col("account_code").isin(*codes), F.col("net_credit_paise"))), F.lit(0)
    )
    per_month = movement.groupBy(LEDGER, "month", "due_month").agg(
        held(roles.output_tax).alias("output_paise"), (-held(roles.input_tax)).alias("input_paise")
    )
    net = F.col("output_paise") - F.col("input_paise")
    due = (F.col("output_paise") > 0) & (F.col("input_paise") >= 0) & (net > 0)
    return per_month.withColumn("net_due_paise", F.when(due, net).otherwise(0))
