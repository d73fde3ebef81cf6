"""Writing what people read: the day book and spreadsheet-safe reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import dates, money, text


def daybook(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Lines in the shape of a day-book export, all text, with the ``keep`` columns as they are."""
    blank = F.lit("")
    rupees = lambda c: F.when(F.col(c) == 0, blank).otherwise(money.format_inr(F.col(c)))
    or_blank = lambda e: F.coalesce(e, blank)
    return lines.select(
        F.col("voucher_id").alias("Voucher No"),
        dates.dmy(F.col("voucher_date")).alias("Date"),
        or_blank(F.date_format("posted_at", "dd-MM-yyyy HH:mm")).alias("Posted"),
        F.initcap(F.replace(F.col("voucher_type"), F.lit("_"), F.lit(" "))).alias("Vch Type"),
        F.col("account_name").alias("Ledger"),
        rupees("debit_paise").alias("Debit"),
        rupees("credit_paise").alias("Credit"),
        or_blank(F.col("narration")).alias("Narration"),
        or_blank(F.col("document_ref")).alias("Doc Ref"),
        F.col("created_by").alias("Entered By"),
        or_blank(F.col("approved_by")).alias("Approved By"),
        *(keep or []),
    )


def spreadsheet_safe(report: DataFrame) -> DataFrame:
    """Every text column made inert for a spreadsheet."""
    safe = {f.name: text.spreadsheet_safe(F.col(f"`{f.name}`")) for f in report.schema.fields if isinstance(f.dataType, T.StringType)}
    return report.withColumns(safe)


def write_csv(report: DataFrame, path: str) -> None:
    spreadsheet_safe(report).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
