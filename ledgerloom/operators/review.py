"""Decisions, engagements, report and queue views. All append-only tables and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER, VOUCHER
from ledgerloom.functions import money
from ledgerloom.operators.fusion import by_strength
from ledgerloom.operators.scale import ranked
from ledgerloom.operators.vouchers import file_order
from ledgerloom.sources.validate import decision_problem

# Fixed values.
DECISION_LABELS = {
    "accept": "Exception — follow up",
    "reject": "Cleared — not a concern",
    "investigate": "Investigating",
    "adjust": "Re-banded",
}
NOT_REVIEWED = "not yet reviewed"
SIMILAR_SHOWN = 3


def check_decisions(incoming: DataFrame) -> DataFrame:
    return incoming.withColumn("problem", decision_problem())


def append_decisions(trail: DataFrame, incoming: DataFrame) -> DataFrame:
    """New trail rows: valid ones only, numbered on from the trail's last sequence."""
    good = check_decisions(incoming).where(F.col("problem").isNull()).drop("problem")
    last = trail.groupBy(F.lit(1).alias("_k")).agg(F.max("sequence").alias("_last"))
    numbered = ranked(good.withColumn("_k", F.lit(1)), ["_k"], ["decided_at", "engagement_id", "voucher_id", "action", "reviewer"], "_n")
    return (
        numbered.join(F.broadcast(last), "_k", "left")
        .withColumn("sequence", F.coalesce(F.col("_last"), F.lit(0)) + F.col("_n"))
        .drop("_k", "_last", "_n")
    )


def current_decisions(trail: DataFrame) -> DataFrame:
    """Latest decision per voucher, as one combining aggregate."""
    rest = [c for c in trail.columns if c not in ("engagement_id", VOUCHER)]
    return trail.groupBy("engagement_id", VOUCHER).agg(F.max_by(F.struct(*rest), "sequence").alias("d")).select(
        "engagement_id", VOUCHER, "d.*"
    )


def findings_decisions(found: DataFrame, trail: DataFrame) -> DataFrame:
    """Findings with where each stands now. ``engagement_id`` of the trail is the ledger id."""
    now = current_decisions(trail).withColumnRenamed("engagement_id", LEDGER)
    joined = found.join(now, KEY, "left")
    return joined.withColumn("status", F.coalesce(F.col("action"), F.lit(NOT_REVIEWED)))


def queue_counts(with_status: DataFrame) -> DataFrame:
    """Per ledger: findings by band and by decision, and what is still open."""
    states = ["accept", "reject", "investigate", "adjust"]
    return with_status.groupBy(LEDGER).agg(
        F.count(F.lit(1)).alias("flagged"),
        *[F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")],
        *[F.count_if(F.col("status") == s).alias(s) for s in states],
        F.count_if(F.col("status") == NOT_REVIEWED).alias("outstanding"),
    )


def concern_counts(found: DataFrame, concerns: Column) -> DataFrame:
    return found.select(LEDGER, F.explode(concerns).alias("concern")).groupBy(LEDGER, "concern").agg(
        F.count(F.lit(1)).alias("findings")
    )


def queue_filter(
    with_status: DataFrame, *, band: str | None = None, concern: str | None = None,
    undocumented: bool = False, state: str | None = None,
) -> DataFrame:
    out = with_status
    if band:
        out = out.where(F.col("band") == band)
    if concern:
        out = out.where(F.array_contains("concerns", concern))
    if undocumented:
        out = out.where(~F.col("has_document"))
    if state == "open":
        out = out.where(F.col("status") == NOT_REVIEWED)
    elif state == "reviewed":
        out = out.where(F.col("status") != NOT_REVIEWED)
    return out


def queue_search(rows: DataFrame, query: str) -> DataFrame:
    """Every word must occur in the voucher's text, or (3+ digits) in its amount's digits.

    ``rows`` needs voucher_id, narration, created_by, account_names and amount_paise.
    """
    hay = F.lower(F.concat_ws(" ", "voucher_id", "narration", "created_by", F.array_join("account_names", " ")))
    digits = money.amount_digits(F.col("amount_paise"))
    test = F.lit(True)
    for word in query.lower().split():
        number = "".join(ch for ch in word if ch in "0123456789")
        hit = F.contains(hay, F.lit(word))
        test = test & ((hit | F.contains(digits, F.lit(number))) if len(number) >= 3 else hit)
    return rows.where(test)


def page(queue: DataFrame, number: int, size: int = 200) -> DataFrame:
    """Page ``number`` (from 1) of each ledger's queue, by the rank it was written with: a filter, no sort."""
    return queue.where(F.col("rank").between((number - 1) * size + 1, number * size))


def owner_scope(engagements: DataFrame, owner_id: str | None) -> DataFrame:
    """The engagements of one owner; all of them where nobody is singled out."""
    return engagements if owner_id is None else engagements.where(F.col("owner_id") == owner_id)


def lines_for(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The ledger lines behind findings, in long form: a voucher of any length stays distributed."""
    return lines.join(found.select(*KEY).distinct(), KEY, "left_semi")


def account_names(lines: DataFrame) -> DataFrame:
    spot = F.struct(file_order().alias("row"), F.col("line_id"))
    named = lines.where(F.col("account_name").isNotNull())
    return named.groupBy(LEDGER, "account_code").agg(F.min_by("account_name", spot).alias("account_name"))


def report_frame(found: DataFrame, trail: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per finding with its reasons, evidence, source lines and latest decision.

    ``found`` carries ``signals`` strongest first (``fusion.with_signals``). The source-line
    cell is a list by design; ``lines_for`` is the form for vouchers of unlimited length.
    """
    behind = lines_for(lines.select(*KEY, "line_id"), found).groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_list("line_id")), ", ").alias("source_lines")
    )
    rows = findings_decisions(found.drop("line_count"), trail).join(behind, KEY, "left")
    label = F.lit("Not yet reviewed")
    for action, words in DECISION_LABELS.items():
        label = F.when(F.col("action") == action, words).otherwise(label)
    blank = lambda e: F.coalesce(e, F.lit(""))
    return rows.select(
        LEDGER,
        "voucher_id",
        F.col("voucher_date").cast("string").alias("date"),
        money.format_inr(F.col("amount_paise")).alias("amount"),
        "amount_paise",
        F.round("priority", 3).alias("priority"),
        "band",
        F.array_join("kinds", "; ").alias("concerns"),
        F.array_join(F.col("signals")["reason"], " | ").alias("reasons"),
        F.col("completeness").alias("evidence_completeness"),
        F.array_join("missing", ", ").alias("evidence_missing"),
        "source_lines",
        label.alias("reviewer_decision"),
        F.col("status").alias("status_code"),
        blank(F.col("reviewer")).alias("reviewer"),
        blank(F.concat(F.date_format("decided_at", "dd-MM-yyyy HH:mm"), F.lit(" UTC"))).alias("decided_at"),
        blank(F.col("note")).alias("note"),
    )


def engagement_rows(lines: DataFrame, digests: DataFrame, scope: str = "") -> DataFrame:
    """One row per ledger: id from the content digest, first entity and year, voucher count."""
    spot = F.struct(file_order().alias("row"), F.col("line_id"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), spot)).alias(c)
    per_voucher = lines.groupBy(*KEY).agg(
        F.min(F.when(F.col("entity_id").isNotNull(), F.struct(spot.alias("s"), F.col("entity_id")))).alias("e"),
        F.min(F.when(F.col("fiscal_year").isNotNull(), F.struct(spot.alias("s"), F.col("fiscal_year")))).alias("y"),
    )
    facts = per_voucher.groupBy(LEDGER).agg(
        F.min("e")["entity_id"].alias("entity_id"),
        F.min("y")["fiscal_year"].alias("fiscal_year"),
        F.count(F.lit(1)).alias("voucher_count"),
    )
    identity = F.col("digest") if not scope else F.sha2(F.concat(F.lit(scope + ":"), "digest"), 256)
    return facts.join(digests, LEDGER).select(
        F.substring(identity, 1, 16).alias("id"),
        LEDGER,
        F.concat_ws(" ", "entity_id", "fiscal_year").alias("name"),
        "entity_id", "fiscal_year", F.col("digest").alias("content_sha256"), "voucher_count",
    )


def same_book(digests: DataFrame, engagements: DataFrame) -> DataFrame:
    """Per ledger: does it match the content an engagement was opened on?"""
    opened = engagements.select(LEDGER, "content_sha256")
    return digests.join(opened, LEDGER).select(LEDGER, (F.col("digest") == F.col("content_sha256")).alias("same_book"))


def engagement_summary(
    engagements: DataFrame, stats: DataFrame, trail: DataFrame, sources: DataFrame, owner_id: str | None = None
) -> DataFrame:
    """Dashboard rows: each table is reduced per engagement first, then joined."""
    e = owner_scope(engagements, owner_id)
    progress = trail.groupBy("engagement_id").agg(
        F.count_distinct("voucher_id").alias("reviewed"), F.max("decided_at").alias("last_decision")
    )
    newest = sources.where("live").groupBy("engagement_id").agg(
        F.max_by("filename", F.struct("uploaded_at", "filename")).alias("latest_file")
    )
    return (
        e.join(stats, e["id"] == stats["engagement_id"], "left").drop("engagement_id")
        .join(progress, F.col("id") == progress["engagement_id"], "left").drop("engagement_id")
        .join(newest, F.col("id") == newest["engagement_id"], "left").drop("engagement_id")
        .withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))
        .withColumn("last_activity", F.greatest("opened_at", "last_decision"))
        .drop("last_decision")
    )

