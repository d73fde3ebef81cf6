"""SAP-shaped extract to canonical lines, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.schema import LINE_COLUMNS

# Fixed values.
LABEL_COLUMNS = ["is_fraud", "is_anomaly", "fraud_type", "anomaly_type"]
DOCUMENT_TYPES = {
    "DR": "sales", "KR": "purchase", "SA": "journal", "HR": "journal", "AA": "journal",
    "DZ": "receipt", "KZ": "payment", "WE": "purchase", "WL": "sales", "OPENING_BALANCE": "opening_balance",
}
CATEGORIES = {
    "asset": "asset", "liability": "liability", "equity": "equity",
    "income": "income", "revenue": "income", "expense": "expense",
}


def lookup(table: dict[str, str], key: Column, otherwise: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(otherwise))


def adapt_sap(extract: DataFrame, ledger_id: Column | None = None) -> DataFrame:
    """Labels are dropped first; fiscal year and period come from the document date."""
    src = extract.drop(*LABEL_COLUMNS)
    day = F.col("document_date").cast("date")
    s = lambda name: F.col(name).cast("string")
    paise = lambda name: F.coalesce(money.float_rupees_to_paise(F.col(name)), F.lit(0).cast("bigint"))
    out = {
        "line_id": F.concat(s("document_id"), F.lit("-"), s("line_number")),
        "voucher_id": s("document_id"),
        "line_number": F.col("line_number").cast("int"),
        "entity_id": s("company_code"),
        "fiscal_year": dates.fiscal_year(day),
        "period": dates.fiscal_period(day),
        "voucher_date": day,
        "posted_at": F.col("posting_date").cast("timestamp_ntz"),
        "time_fidelity": F.lit("date_only"),
        "voucher_type": lookup(DOCUMENT_TYPES, s("document_type"), "other"),
        "account_code": s("gl_account"),
        "account_name": F.coalesce(s("account_description"), F.lit("Unnamed account")),
        "account_group": lookup(CATEGORIES, F.lower(s("financial_statement_category")), "asset"),
        "debit_paise": paise("debit_amount"),
        "credit_paise": paise("credit_amount"),
        "currency": F.coalesce(s("currency"), F.lit("USD")),
        "created_by": F.coalesce(s("created_by"), F.lit("UNKNOWN")),
        "approved_by": F.lit(None).cast("string"),
        "document_ref": s("reference"),
        "narration": F.coalesce(s("line_text"), s("header_text")),
        "cost_centre": s("cost_center"),
        "is_manual": F.coalesce(F.col("is_manual").cast("boolean"), F.lit(False)),
        "is_post_close": F.coalesce(F.col("is_post_close").cast("boolean"), F.lit(False)),
        "source_row": F.lit(None).cast("bigint"),
    }
    key = ledger_id if ledger_id is not None else F.concat_ws("/", out["entity_id"], out["fiscal_year"])
    return src.select(key.alias("ledger_id"), *[e.alias(c) for c, e in out.items()]).select(*LINE_COLUMNS)
