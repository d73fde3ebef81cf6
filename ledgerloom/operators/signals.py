"""The review signals.

A hit is ``(ledger_id, voucher_id, kind, strength, reason, evidence)`` with evidence as JSON.
Signals that can be decided from a voucher and its context share one pass: each is a struct
that is null when the signal stays silent, and the pass explodes the array of structs.
Signals that need neighbours (duplicates) or a sparse lookup (round amounts) build their own
hits. ``REGISTRY`` is the extension point: add a ``RowSignal`` or a ``FrameSignal``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import ALL_KINDS, KEY, LEDGER, RULE_KINDS, SIGNAL_WEIGHTS
from ledgerloom.functions.dates import dmy
from ledgerloom.functions.money import format_inr
from ledgerloom.operators.scale import previous_row, salted_join, stage
from ledgerloom.operators.statistics import deviation
from ledgerloom.operators.vouchers import LedgerFrames

HIT_COLUMNS = [*KEY, "kind", "strength", "reason", "evidence"]


@dataclass(frozen=True)
class RowSignal:
    """A signal decided from one row of ``frames.context(*needs)``."""

    kind: str
    fires: Callable[[], Column]
    strength: Callable[[], Column]
    reason: Callable[[], Column]
    evidence: Callable[[], list[Column]]
    needs: tuple[str, ...] = ()

    def struct(self, detail: bool = True) -> Column:
        body = [F.lit(self.kind).alias("kind"), self.strength().cast("double").alias("strength")]
        if detail:
            body += [self.reason().alias("reason"), F.to_json(F.struct(*self.evidence())).alias("evidence")]
        return F.when(self.fires(), F.struct(*body))


@dataclass(frozen=True)
class FrameSignal:
    """A signal that builds its own hits from the frames."""

    kind: str
    hits: Callable[[LedgerFrames], DataFrame]


def c(name: str) -> Column:
    return F.col(name)


def text(column: Column) -> Column:
    return column.cast("string")


# --- signals decided from one voucher ----------------------------------------


def off_hours() -> RowSignal:
    hour = F.hour("posted_at")
    pad = lambda x: F.lpad(text(x), 2, "0")
    return RowSignal(
        "off_hours_posting",
        lambda: (c("fidelity") == "date_and_time")
        & c("posted_at").isNotNull()
        & ((hour >= c("t_off_hours_start")) | (hour < c("t_off_hours_end"))),
        lambda: F.lit(0.8),
        lambda: F.concat(
            F.lit("Entered at "), F.date_format("posted_at", "HH:mm"), F.lit(", outside the working day ("),
            pad(c("t_off_hours_end")), F.lit(":00–"), pad(c("t_off_hours_start")), F.lit(":00)."),
        ),
        lambda: [
            text(c("posted_at")).alias("posted_at"),
            hour.alias("hour"),
            F.array("t_off_hours_end", "t_off_hours_start").alias("working_window"),
        ],
    )


def weekend() -> RowSignal:
    timed = (c("fidelity") == "date_and_time") & c("posted_at").isNotNull()
    day = F.when(timed, c("posted_at").cast("date")).otherwise(c("voucher_date"))
    basis = F.when(timed, "posted").otherwise("dated")
    return RowSignal(
        "weekend_posting",
        lambda: F.weekday(day) == 6,
        lambda: F.lit(0.6),
        lambda: F.concat(F.lit("Entry "), basis, F.lit(" on Sunday "), dmy(day), F.lit(", when the office is closed.")),
        lambda: [
            basis.alias("basis"),
            text(day).alias("date"),
            F.lit("Sunday").alias("weekday"),
            text(c("voucher_date")).alias("voucher_date"),
        ],
    )


def period_end() -> RowSignal:
    days = F.datediff("year_end", "voucher_date")
    missing = F.array_compact(
        F.array(
            F.when(c("document_ref").isNull(), "supporting document"),
            F.when(c("approved_by").isNull(), "approval"),
        )
    )
    return RowSignal(
        "period_end_concentration",
        lambda: days.between(0, c("t_period_end_window_days")) & c("is_manual") & (F.size(missing) > 0),
        lambda: F.lit(0.85),
        lambda: F.concat(
            F.lit("Manual entry dated "), dmy(c("voucher_date")), F.lit(", at the year end, with no "),
            F.array_join(missing, " and no "), F.lit("."),
        ),
        lambda: [
            text(c("voucher_date")).alias("voucher_date"),
            text(c("year_end")).alias("year_end"),
            days.alias("days_before_close"),
            missing.alias("missing"),
        ],
    )


def rare_pair() -> RowSignal:
    seen = c("rarest.times_seen")
    return RowSignal(
        "rare_account_pair",
        lambda: ~c("rare_abstains") & (seen <= c("rare_ceiling")),
        lambda: F.lit(0.75),
        lambda: F.concat(
            F.lit("Accounts "), c("rarest.debit_account"), F.lit(" and "), c("rarest.credit_account"),
            F.lit(" appear together only "), text(seen), F.lit(" time(s) in a ledger of "),
            F.format_number("n_vouchers", 0), F.lit(" vouchers."),
        ),
        lambda: [
            c("rarest.debit_account").alias("debit_account"),
            c("rarest.credit_account").alias("credit_account"),
            seen.alias("times_seen"),
            c("rare_ceiling").alias("rare_below"),
            c("n_vouchers").alias("vouchers_in_ledger"),
            c("account_names").alias("account_names"),
        ],
        ("pairs",),
    )


def threshold_adjacent() -> RowSignal:
    limit, amount = c("t_approval_limit_paise"), c("amount_paise")
    return RowSignal(
        "threshold_adjacent",
        lambda: (amount >= limit - c("t_threshold_band_paise")) & (amount < limit) & c("approved_by").isNull(),
        lambda: F.lit(0.8),
        lambda: F.concat(
            format_inr(amount), F.lit(" falls "), format_inr(limit - amount), F.lit(" below the "),
            format_inr(limit), F.lit(" approval limit and carries no approver."),
        ),
        lambda: [
            amount.alias("amount_paise"),
            limit.alias("approval_limit_paise"),
            (limit - amount).alias("shortfall_paise"),
        ],
    )


def missing_evidence() -> RowSignal:
    amount = c("amount_paise")
    return RowSignal(
        "missing_evidence",
        lambda: c("is_manual") & (amount >= c("t_materiality_paise")) & (c("evidence_lines") == 0),
        lambda: F.lit(0.9),
        lambda: F.concat(
            F.lit("Manual entry of "), format_inr(amount),
            F.lit(" with no supporting document reference on any of its "), text(c("line_count")), F.lit(" lines."),
        ),
        lambda: [
            amount.alias("amount_paise"),
            c("t_materiality_paise").alias("materiality_paise"),
            c("line_count").alias("lines"),
            c("evidence_lines").alias("lines_with_evidence"),
            c("is_manual").alias("is_manual"),
        ],
    )


def unusual_preparer() -> RowSignal:
    s = "stranger."
    percent = F.format_string("%.0f%%", c(s + "owner_share") * 100)
    return RowSignal(
        "unusual_preparer_account",
        lambda: c("stranger").isNotNull(),
        lambda: F.lit(0.7),
        lambda: F.concat(
            F.lit("Account "), c(s + "account_code"), F.lit(" is normally handled by "), c(s + "owner"),
            F.lit(" ("), percent, F.lit(" of its "), text(c(s + "total")),
            F.lit(" entries), but this voucher was posted by "), c("created_by"),
            F.lit(", who has touched it "), text(c(s + "entries")), F.lit(" time(s)."),
        ),
        lambda: [
            c("created_by").alias("created_by"),
            c(s + "account_code").alias("account_code"),
            c(s + "owner").alias("regular_owner"),
            F.round(c(s + "owner_share"), 3).alias("regular_owner_share"),
            c(s + "entries").alias("entries_by_this_preparer"),
            c(s + "total").alias("entries_on_account_total"),
        ],
        ("preparer",),
    )


def post_close() -> RowSignal:
    lag = F.datediff(c("posted_at").cast("date"), c("voucher_date"))
    late = F.coalesce(lag > c("t_post_close_lag_days"), F.lit(False))
    return RowSignal(
        "post_close_entry",
        lambda: c("is_post_close") | late,
        lambda: F.lit(0.85),
        lambda: F.when(
            late, F.concat(F.lit("Dated "), dmy(c("voucher_date")), F.lit(" but entered "), text(lag), F.lit(" days later."))
        ).otherwise(
            F.concat(F.lit("Marked as posted after the books were closed ("), dmy(c("voucher_date")), F.lit(")."))
        ),
        lambda: [
            text(c("voucher_date")).alias("voucher_date"),
            text(c("posted_at")).alias("posted_at"),
            lag.alias("lag_days"),
            c("is_post_close").alias("source_flag"),
        ],
    )


def amount_outlier() -> RowSignal:
    score, limit = deviation(), c("t_amount_deviation_threshold")
    account = F.coalesce(F.try_element_at("debit_accounts", F.lit(1)), F.lit(""))
    whole = lambda name: F.bround(c(name)).cast("bigint")
    return RowSignal(
        "amount_outlier",
        lambda: score >= limit,
        lambda: F.least(F.lit(1.0), score / (limit * 3)),
        lambda: F.concat(
            format_inr(c("amount_paise")), F.lit(" is "), F.format_string("%.1f", score),
            F.lit(" robust deviations from the usual amount on account "), account, F.lit("."),
        ),
        lambda: [
            c("amount_paise").alias("amount_paise"),
            account.alias("account_code"),
            F.round(score, 2).alias("robust_deviations"),
            limit.alias("threshold"),
            F.lit("median absolute deviation of log10 amount").alias("measure"),
            whole("median_paise").alias("account_median_paise"),
            whole("low_paise").alias("typical_low_paise"),
            whole("high_paise").alias("typical_high_paise"),
            c("account_entries").alias("entries_compared"),
        ],
        ("amounts",),
    )


# --- signals with their own frames --------------------------------------------

def sparse_hits(df: DataFrame, kind: str, strength: Column, reason: Column, evidence: list[Column]) -> DataFrame:
    return df.select(
        *KEY,
        F.lit(kind).alias("kind"),
        strength.cast("double").alias("strength"),
        reason.alias("reason"),
        F.to_json(F.struct(*evidence)).alias("evidence"),
    )


def duplicate_pairs(frames: LedgerFrames) -> DataFrame:
    """Vouchers with the one before them of equal amount and accounts, within the window."""
    group = [LEDGER, "amount_paise", "accounts_a", "accounts_b"]
    rows = frames.vouchers.where(c("voucher_date").isNotNull()).select(
        LEDGER, "amount_paise", F.xxhash64("accounts").alias("accounts_a"),
        F.xxhash64(F.lit("accounts"), "accounts").alias("accounts_b"), "voucher_date", "voucher_id",
    )
    # Few amounts recur on the same accounts: only those groups are ordered.
    recurring = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_vouchers")).where(c("group_vouchers") > 1)
    rows = stage(salted_join(rows, recurring, group, weight="group_vouchers", salt_by=["voucher_id"], how="inner"))
    chained = previous_row(rows, group, ["voucher_date", "voucher_id"], "earlier").where(c("earlier").isNotNull())
    chained = chained.withColumn("days_apart", F.datediff(c("voucher_date"), c("earlier.voucher_date")))
    window = frames.times.select(LEDGER, "n_vouchers", "t_duplicate_window_days")
    return salted_join(
        chained, window, [LEDGER], weight="n_vouchers", salt_by=["voucher_id"], how="inner"
    ).where(c("days_apart").between(0, c("t_duplicate_window_days")))


def duplicate_entry(frames: LedgerFrames) -> DataFrame:
    gap = c("days_apart")
    return sparse_hits(
        duplicate_pairs(frames),
        "duplicate_entry",
        1.0 - gap / (c("t_duplicate_window_days") + 1),
        F.concat(
            F.lit("Same amount "), format_inr(c("amount_paise")), F.lit(" posted to the same accounts "),
            text(gap), F.lit(" day(s) after "), c("earlier.voucher_id"), F.lit("."),
        ),
        [
            c("amount_paise").alias("amount_paise"),
            gap.alias("days_apart"),
            c("earlier.voucher_id").alias("earlier_voucher_id"),
            text(c("earlier.voucher_date")).alias("earlier_date"),
        ],
    )


def round_candidates(frames: LedgerFrames) -> DataFrame:
    """Round, large vouchers with the most often their exact total recurs on their accounts."""
    limits = frames.times.select(
        LEDGER, "n_vouchers", "t_round_min_paise", "t_round_step_paise", "t_routine_repeat_count"
    )
    group = [LEDGER, "accounts", "amount_paise"]
    round_ones = salted_join(
        frames.vouchers.select(*KEY, "accounts", "amount_paise"), limits, [LEDGER],
        weight="n_vouchers", salt_by=["voucher_id"], how="inner",
    ).where(
        (c("amount_paise") >= c("t_round_min_paise")) & (c("amount_paise") % c("t_round_step_paise") == 0)
    )
    # One lookup per distinct (accounts, amount), not per voucher.
    combos = round_ones.groupBy(*group).agg(F.count(F.lit(1)).alias("combo_vouchers"))
    looked = combos.withColumn("account_code", F.explode("accounts")).join(
        frames.account_amounts, [LEDGER, "account_code", "amount_paise"], "left"
    )
    repeats = looked.groupBy(*group).agg(
        F.max("combo_vouchers").alias("combo_vouchers"),
        F.coalesce(F.max("times_seen"), F.lit(0)).alias("times_seen"),
    )
    repeats = stage(repeats)
    return salted_join(round_ones, repeats, group, weight="combo_vouchers", salt_by=["voucher_id"], how="inner")


def round_amount(frames: LedgerFrames) -> DataFrame:
    seen = c("times_seen")
    return sparse_hits(
        round_candidates(frames).where(seen < c("t_routine_repeat_count")),
        "round_amount",
        F.lit(0.7),
        F.concat(
            format_inr(c("amount_paise")),
            F.lit(" is an exactly round amount and this figure does not recur on these accounts (seen "),
            text(seen), F.lit(" time(s))."),
        ),
        [
            c("amount_paise").alias("amount_paise"),
            c("t_round_step_paise").alias("round_step_paise"),
            seen.alias("times_seen_on_account"),
            c("accounts").alias("accounts"),
        ],
    )


def ml_anomaly(frames: LedgerFrames) -> DataFrame:
    from ledgerloom.operators.forest import ml_anomaly_hits

    return ml_anomaly_hits(frames)


def built_in() -> dict[str, RowSignal | FrameSignal]:
    """Every built-in signal by kind, in the order a reviewer sees them."""
    signals = [
        FrameSignal("duplicate_entry", duplicate_entry),
        FrameSignal("round_amount", round_amount),
        off_hours(),
        weekend(),
        period_end(),
        rare_pair(),
        threshold_adjacent(),
        missing_evidence(),
        unusual_preparer(),
        post_close(),
        amount_outlier(),
        FrameSignal("ml_anomaly", ml_anomaly),
    ]
    return {s.kind: s for s in signals}


def run_signals(
    frames: LedgerFrames,
    enabled: Iterable[str] = tuple(RULE_KINDS),
    registry: dict[str, RowSignal | FrameSignal] | None = None,
    *,
    detail: bool = True,
) -> DataFrame:
    """Hits of the enabled signals; the row-local ones come out of a single pass.

    ``detail=False`` leaves out reasons and evidence, which ranking does not read.
    """
    known = registry or built_in()
    chosen = [known[k] for k in known if k in set(enabled)]
    rows = [s for s in chosen if isinstance(s, RowSignal)]
    columns = HIT_COLUMNS if detail else HIT_COLUMNS[:4]
    parts = [s.hits(frames).select(*columns) for s in chosen if isinstance(s, FrameSignal)]
    if rows:
        needs = sorted({n for s in rows for n in s.needs})
        fired = F.array_compact(F.array(*[s.struct(detail) for s in rows]))
        wide = frames.context(*needs).select(*KEY, F.explode(fired).alias("hit"))
        parts.append(wide.select(*KEY, "hit.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def registry_table(spark, registry: dict | None = None) -> DataFrame:
    known = registry or built_in()
    layer = {"amount_outlier": "statistics", "ml_anomaly": "model"}
    rows = [
        (i, kind, layer.get(kind, "rule"), float(SIGNAL_WEIGHTS.get(kind, 0.0)))
        for i, kind in enumerate(known, start=1)
    ]
    return spark.createDataFrame(rows, "position int, kind string, layer string, weight double")


def hits_by_kind(hits: DataFrame, kinds: list[str] | None = None, ledgers: DataFrame | None = None) -> DataFrame:
    """Distinct vouchers per ledger and kind, zero where a kind found nothing.

    ``ledgers`` names the ledgers to report on; without it, those with any hit.
    """
    ledgers = (hits if ledgers is None else ledgers).select(LEDGER).distinct()
    every = F.explode(F.array(*map(F.lit, kinds or ALL_KINDS))).alias("kind")
    found = hits.select(*KEY, "kind").distinct().groupBy(LEDGER, "kind").agg(F.count(F.lit(1)).alias("vouchers"))
    return (
        ledgers.select(LEDGER, every)
        .join(found, [LEDGER, "kind"], "left")
        .withColumn("vouchers", F.coalesce(F.col("vouchers"), F.lit(0)))
    )


def flagged_vouchers(hits: DataFrame, kind: str | None = None) -> DataFrame:
    return (hits if kind is None else hits.where(F.col("kind") == kind)).select(*KEY).distinct()


def hits_by_voucher(hits: DataFrame) -> DataFrame:
    """Hits collected per voucher (at most one per kind), sorted by kind."""
    one = F.struct("kind", "strength", "reason", "evidence")
    return hits.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("signals"))


def sorted_hits(hits: DataFrame) -> DataFrame:
    """Hits by voucher and kind: a range shuffle, each task sorts its own range."""
    return hits.orderBy(*KEY, "kind")
