"""How well a voucher is supported: document, approval, narration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import KEY
from ledgerloom.functions.text import present

EVIDENCE_COLUMNS = [
    "completeness", "has_document", "has_approval", "approval_expected", "has_narration",
    "document_coverage", "missing",
]


def missing_items(has_document: Column, has_approval: Column, expected: Column, has_narration: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~has_document, "supporting document"),
            F.when(expected & ~has_approval, "approval"),
            F.when(~has_narration, "narration"),
        )
    )


def evidence_summary(missing: Column) -> Column:
    return F.when(
        F.size(missing) == 0, "Fully supported: document, approval and narration all present."
    ).otherwise(F.concat(F.lit("No "), F.array_join(missing, " and no "), F.lit(".")))


def evidence_columns() -> list[Column]:
    """Evidence columns over ``frames.context()``. Approval counts only where the limit asks for it."""
    coverage = F.col("evidence_lines") / F.greatest(F.col("line_count"), F.lit(1))
    has_document = F.col("evidence_lines") > 0
    has_approval, has_narration = present(F.col("approved_by")), present(F.col("narration"))
    expected = F.col("amount_paise") >= F.col("t_approval_limit_paise")

    def part(condition: Column, weight: float) -> Column:
        return F.when(condition, weight).otherwise(0.0)

    earned = coverage * C.DOCUMENT_WEIGHT + part(has_narration, C.NARRATION_WEIGHT) + part(
        expected & has_approval, C.APPROVAL_WEIGHT
    )
    available = F.lit(C.DOCUMENT_WEIGHT + C.NARRATION_WEIGHT) + part(expected, C.APPROVAL_WEIGHT)
    return [
        F.round(earned / available, 4).alias("completeness"),
        has_document.alias("has_document"),
        has_approval.alias("has_approval"),
        expected.alias("approval_expected"),
        has_narration.alias("has_narration"),
        F.round(coverage, 4).alias("document_coverage"),
        missing_items(has_document, has_approval, expected, has_narration).alias("missing"),
    ]


def evidence_scores(context: DataFrame) -> DataFrame:
    return context.select(*KEY, *evidence_columns())


def evidence_states(context: DataFrame, not_in_file: list[str]) -> DataFrame:
    """Four states per item; a column the file never had is neither present nor missing."""

    def state(name: str, ok: Column, expected: Column, column: str) -> Column:
        seen = F.when(ok, "present").when(~expected, "not_expected").otherwise("missing")
        absent = F.lit(column in not_in_file)
        return F.struct(F.lit(name).alias("item"), F.when(absent, "not_in_file").otherwise(seen).alias("state"))

    scored = context.select(*KEY, *evidence_columns())
    items = F.array(
        state("Supporting document", F.col("has_document"), F.lit(True), "document_ref"),
        state("Approval", F.col("has_approval"), F.col("approval_expected"), "approved_by"),
        state("Narration", F.col("has_narration"), F.lit(True), "narration"),
    )
    counted = F.filter("items", lambda x: x["state"].isin("present", "missing"))
    have = F.filter("items", lambda x: x["state"] == "present")
    return scored.select(*KEY, items.alias("items")).select(
        *KEY, "items", F.size(have).alias("present_items"), F.size(counted).alias("expected_items")
    )
