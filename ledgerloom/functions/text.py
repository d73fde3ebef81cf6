"""Text rules shared by intake, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import ACCOUNT_GROUPS

# Words that name a voucher type, tried in this order.
VOUCHER_TYPE_WORDS = [
    ("sales", "sales"),
    ("sale", "sales"),
    ("purchase", "purchase"),
    ("purc", "purchase"),
    ("receipt", "receipt"),
    ("payment", "payment"),
    ("contra", "contra"),
    ("journal", "journal"),
    ("jrnl", "journal"),
    ("debit note", "debit_note"),
    ("credit note", "credit_note"),
    ("opening", "opening_balance"),
]
SAFE_LOG_TEXT = r"^[A-Za-z0-9_.:-]{1,64}$"
REDACTED = "[redacted]"


def blank_to_null(text: Column) -> Column:
    """Null for blank text; other text unchanged."""
    return F.when(F.length(F.trim(text)) > 0, text)


def clean(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def present(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def truthy(text: Column, words: tuple[str, ...] = ("true", "yes", "1", "y")) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*words), F.lit(False))


def normalised_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _first_word(text: Column, table: list[tuple[str, str]], otherwise: str) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    chain = None
    for word, name in table:
        hit = low.contains(word)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(otherwise)


def voucher_type(text: Column) -> Column:
    return _first_word(text, VOUCHER_TYPE_WORDS, "other")


def account_group(text: Column) -> Column:
    table = [(g, g) for g in ACCOUNT_GROUPS] + [("revenue", "income")]
    return _first_word(text, table, "asset")


def redact(text: Column) -> Column:
    """Identifier-shaped text passes; anything a person could have written is masked."""
    return F.when(text.isNull(), "-").when(text.rlike(SAFE_LOG_TEXT), text).otherwise(REDACTED)


def spreadsheet_safe(text: Column) -> Column:
    """Prefix an apostrophe to text a spreadsheet would run as a formula."""
    runs = text.rlike(r"^[\t\r]") | text.rlike(r"^\s*[=+\-@\t\r]")
    return F.when(runs, F.concat(F.lit("'"), text)).otherwise(text)
