"""Arbitrary ledger text to canonical lines, disclosing what was derived or defaulted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators.scale import salted_join, stage
from ledgerloom.operators.vouchers import number_lines
from ledgerloom.schema import CONTENT_COLUMNS, LINE_COLUMNS
from ledgerloom.sources.mapping import check_usable, map_headers, use_posting_date

ROW = "source_row"


@dataclass
class Disclosure:
    """What happened to the columns of one file."""

    mapped: dict[str, str] = field(default_factory=dict)
    derived: list[str] = field(default_factory=list)
    defaulted: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)
    encoding: str | None = None


def named(header: str) -> Column:
    """A column by its literal header, dots and all."""
    return F.col("`" + header.replace("`", "``") + "`")


def drop_blank_rows(raw: DataFrame) -> DataFrame:
    """Rows where every file column is null go; their row numbers stay with the others."""
    cells = [named(c).cast("string") for c in raw.columns if c not in (ROW, "ledger_id")]
    return raw.where(F.coalesce(*cells).isNotNull()) if len(cells) > 1 else raw.where(cells[0].isNotNull())


def is_canonical(raw: DataFrame) -> bool:
    return set(CONTENT_COLUMNS) <= set(raw.columns)


def whole_number(column: Column) -> Column:
    value = column.cast("string").try_cast("double")
    return F.coalesce(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint"), F.lit(0).cast("bigint"))


def coerce_types(raw: DataFrame) -> DataFrame:
    """Canonical columns that arrived as text back to their types. Bad numbers are 0, bad dates null."""
    as_text = lambda name: F.col(name).cast("string")
    typed = {
        **{c: whole_number(F.col(c)).cast("int") for c in ("line_number", "period")},
        **{c: whole_number(F.col(c)) for c in ("debit_paise", "credit_paise")},
        "voucher_date": as_text("voucher_date").try_cast("timestamp_ntz").cast("date"),
        "posted_at": as_text("posted_at").try_cast("timestamp_ntz"),
        **{c: text.truthy(F.col(c), ("true", "t", "yes", "y", "1")) for c in ("is_manual", "is_post_close")},
        **{c: text.blank_to_null(F.col(c)) for c in ("approved_by", "document_ref", "narration", "cost_centre")},
    }
    return raw.withColumns({c: e for c, e in typed.items() if c in raw.columns})


def amounts(columns: list[str], report: Disclosure) -> dict[str, Column]:
    """Debit and credit paise from paise columns, rupee columns or one signed amount; never mixed."""
    zero = F.lit(0).cast("bigint")
    if {"debit_paise", "credit_paise"} & set(columns):
        return {s: money.paise_text(F.col(s)) if s in columns else zero for s in ("debit_paise", "credit_paise")}
    if {"debit", "credit"} & set(columns):
        report.derived.append("debit_paise / credit_paise (converted from rupees)")
        return {
            s + "_paise": money.rupee_text_to_paise(F.col(s)) if s in columns else zero for s in ("debit", "credit")
        }
    report.derived.append("debit_paise / credit_paise (split from a signed amount)")
    signed = money.rupee_text_to_paise(F.col("amount"))
    return {"debit_paise": F.greatest(signed, zero), "credit_paise": F.greatest(-signed, zero)}


def conform(
    raw: DataFrame,
    *,
    ledger_id: str | None = None,
    overrides: dict[str, str] | None = None,
    encoding: str | None = None,
) -> tuple[DataFrame, DataFrame, Disclosure]:
    """Text rows (with ``source_row``) to ``(lines, one-row report, disclosure)``."""
    headers = [c for c in raw.columns if c not in (ROW, "ledger_id")]
    report = Disclosure(encoding=encoding)
    rows = drop_blank_rows(raw)
    if is_canonical(raw):
        report.mapped = {h: h for h in headers}
        lines = with_ledger(coerce_types(rows), ledger_id).select(*LINE_COLUMNS)
        return lines, canonical_report(rows, report), report

    found = use_posting_date(map_headers(headers, overrides))
    report.mapped, report.ignored, report.ambiguous = dict(found.resolved), found.unmapped, found.ambiguous
    check_usable(found)
    own = ["ledger_id"] if "ledger_id" in raw.columns else []
    src = rows.select(ROW, *own, *[named(h).cast("string").alias(f) for h, f in found.resolved.items()])
    # Text is parsed in one pass and kept; numbering, fidelity and counts read the typed table.
    dated = stage(typed_columns(src, report, own), wide=True)
    kept = with_ledger(dated.where(usable()), ledger_id).drop("unread_date")
    kept = with_file_fidelity(kept, "posted_at" in src.columns)
    lines = number_lines(kept).select(*LINE_COLUMNS)
    return lines, mapped_report(dated, report), report


def usable() -> Column:
    return F.col("voucher_id").isNotNull() & F.col("voucher_date").isNotNull()


def typed_columns(src: DataFrame, report: Disclosure, own: list[str]) -> DataFrame:
    """Every canonical column from the mapped text, before rows without id or date are dropped."""
    have = src.columns
    stamps = {"day_read": dates.parse_ledger_date(F.col("voucher_date"))}
    if "posted_at" in have:
        stamps["posted_read"] = dates.parse_ledger_date(F.col("posted_at"))
    src = src.withColumns(stamps)
    out: dict[str, Column] = {}
    plain = {"account_name": None, "narration": None, "document_ref": None, "approved_by": None, "cost_centre": None,
             "created_by": "unknown", "entity_id": "UNKNOWN"}
    for name, default in plain.items():
        if name in have:
            out[name] = text.clean(F.col(name))
        else:
            out[name] = F.lit(default).cast("string")
            report.defaulted.append(name)
    if "currency" in have:
        out["currency"] = F.coalesce(text.clean(F.col("currency")), F.lit("INR"))
    else:
        out["currency"] = F.lit("INR")
        report.defaulted.append("currency")
    out |= amounts(have, report)
    day = F.col("day_read")
    out["unread_date"] = day.isNull() & text.present(F.col("voucher_date"))
    out["voucher_date"] = day.cast("date")
    if "posted_at" in have:
        out["posted_at"] = F.col("posted_read")
    else:
        out["posted_at"] = F.lit(None).cast("timestamp_ntz")
        report.defaulted.append("posted_at")
    out["fiscal_year"], out["period"] = dates.fiscal_year(day), dates.fiscal_period(day)
    report.derived += ["fiscal_year", "period"]
    out["voucher_id"] = text.clean(F.col("voucher_id"))
    if "account_code" in have:
        out["account_code"] = F.coalesce(text.clean(F.col("account_code")), F.lit("UNKNOWN"))
    else:
        out["account_code"] = F.coalesce(text.clean(F.col("account_name")), F.lit("UNKNOWN"))
        report.derived.append("account_code (from the ledger name)")
    if "voucher_type" in have:
        out["voucher_type"] = text.voucher_type(F.col("voucher_type"))
        report.derived.append("voucher_type (matched to known types)")
    else:
        out["voucher_type"] = F.lit("other")
        report.defaulted.append("voucher_type")
    if "account_group" in have:
        out["account_group"] = text.account_group(F.col("account_group"))
    else:
        out["account_group"] = F.lit("asset")
        report.defaulted.append("account_group")
    for name in ("is_manual", "is_post_close"):
        if name in have:
            out[name] = text.truthy(F.col(name))
        else:
            out[name] = F.lit(False)
            report.defaulted.append(name)
    return src.select(ROW, *own, *[e.alias(c) for c, e in out.items()])


def with_ledger(lines: DataFrame, ledger_id: str | None) -> DataFrame:
    if "ledger_id" in lines.columns:
        return lines
    named = F.lit(ledger_id) if ledger_id else F.concat_ws("/", "entity_id", "fiscal_year")
    return lines.withColumn("ledger_id", named)


def with_file_fidelity(lines: DataFrame, has_column: bool) -> DataFrame:
    """Time fidelity per ledger: real clock anywhere, dates only, or no posting column at all."""
    if not has_column:
        return lines.withColumn("time_fidelity", F.lit("unknown"))
    per_ledger = lines.groupBy("ledger_id").agg(
        F.when(F.coalesce(F.max(dates.has_clock(F.col("posted_at"))), F.lit(False)), "date_and_time")
        .otherwise("date_only").alias("time_fidelity"),
        F.count(F.lit(1)).alias("ledger_rows"),
    )
    return salted_join(
        lines, per_ledger, ["ledger_id"], weight="ledger_rows", salt_by=["voucher_id", ROW], how="inner"
    ).drop("ledger_rows")


# What a missing column means for the review.
NOTES = {
    "document_ref": "This file has no supporting-document column, so every entry looks undocumented. "
    "Evidence findings will not be meaningful until one is supplied.",
    "approved_by": "This file has no approver column, so approval cannot be checked.",
    "posted_at": "This file records no posting time, so out-of-hours entries cannot be identified.",
}


def mapped_report(dated: DataFrame, report: Disclosure) -> DataFrame:
    return report_row(dated.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(usable()).alias("rows_out"),
        F.count_if("unread_date").alias("unreadable_dates"),
    ), report)


def canonical_report(rows: DataFrame, report: Disclosure) -> DataFrame:
    n = F.count(F.lit(1))
    return report_row(rows.agg(n.alias("rows_in"), n.alias("rows_out"), F.lit(0).cast("bigint").alias("unreadable_dates")), report)


def report_row(one: DataFrame, report: Disclosure) -> DataFrame:
    """One row: what was read and used, how each column was handled, and notes for a person."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    n = F.col("unreadable_dates")
    not_utf8 = report.encoding is not None and report.encoding not in ("utf-8", "utf-8-sig")
    notes = F.array_compact(
        F.array(
            F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(
                " row(s) had a voucher date that could not be read and were left out of the review."))),
            F.when(F.lit(not_utf8), f"This file was not UTF-8; it was read as {(report.encoding or '').upper()}."),
            *[F.when(F.lit(c in report.defaulted), note) for c, note in NOTES.items()],
        )
    )
    return one.select(
        "rows_in", "rows_out", "unreadable_dates",
        F.lit(len(report.mapped)).alias("mapped_columns"),
        strings(sorted(report.mapped.values())).alias("mapped"),
        strings(report.derived).alias("derived"),
        strings(report.defaulted).alias("defaulted"),
        strings(report.ignored).alias("ignored"),
        strings(sorted(report.ambiguous)).alias("ambiguous"),
        F.lit(report.encoding).alias("encoding"),
        notes.alias("notes"),
    )
