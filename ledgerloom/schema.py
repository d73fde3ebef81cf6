"""The canonical journal line."""

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

LINE = T.StructType(
    [
        T.StructField("ledger_id", S, False),
        T.StructField("line_id", S, False),
        T.StructField("voucher_id", S, False),
        T.StructField("line_number", I, False),
        T.StructField("entity_id", S, False),
        T.StructField("fiscal_year", S, False),
        T.StructField("period", I, False),
        T.StructField("voucher_date", T.DateType(), False),
        T.StructField("posted_at", T.TimestampNTZType(), True),
        T.StructField("time_fidelity", S, False),
        T.StructField("voucher_type", S, False),
        T.StructField("account_code", S, False),
        T.StructField("account_name", S, False),
        T.StructField("account_group", S, False),
        T.StructField("debit_paise", L, False),
        T.StructField("credit_paise", L, False),
        T.StructField("currency", S, False),
        T.StructField("created_by", S, False),
        T.StructField("approved_by", S, True),
        T.StructField("document_ref", S, True),
        T.StructField("narration", S, True),
        T.StructField("cost_centre", S, True),
        T.StructField("is_manual", B, False),
        T.StructField("is_post_close", B, False),
        T.StructField("source_row", L, True),
    ]
)

LINE_COLUMNS = [f.name for f in LINE.fields]
#: Columns a raw file must carry to count as canonical already.
CONTENT_COLUMNS = [c for c in LINE_COLUMNS if c not in ("ledger_id", "source_row")]

VOUCHER_TYPES = [
    "journal", "payment", "receipt", "contra", "sales", "purchase",
    "debit_note", "credit_note", "opening_balance", "other",
]
ACCOUNT_GROUPS = ["asset", "liability", "equity", "income", "expense"]
TIME_FIDELITIES = ["date_and_time", "date_only", "unknown"]
