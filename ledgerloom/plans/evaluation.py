"""Measuring a queue against a truth table ``(ledger_id, voucher_id, anomalies, decoys)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import KEY, LEDGER
from ledgerloom.operators.evidence import evidence_columns
from ledgerloom.operators.fusion import fuse, strongest
from ledgerloom.operators.scale import HOT_ROWS, ranked, stage
from ledgerloom.operators.vouchers import LedgerFrames
from ledgerloom.plans.review import EVERYTHING, all_hits

# Which planted kind each signal answers for, and the look-alike meant to trap it.
RESPONSIBILITY = {
    "duplicate_entry": "duplicate_payment",
    "round_amount": "round_amount",
    "off_hours_posting": "after_hours_posting",
    "weekend_posting": "weekend_posting",
    "period_end_concentration": "period_end_concentration",
    "rare_account_pair": "rare_account_pair",
    "threshold_adjacent": "threshold_adjacent",
    "missing_evidence": "missing_document_ref",
    "unusual_preparer_account": "unusual_preparer_account",
    "post_close_entry": "post_close_entry",
}
TRAPS = {
    "duplicate_entry": "legit_recurring_emi",
    "round_amount": "legit_round_rent",
    "weekend_posting": "legit_saturday_posting",
    "period_end_concentration": "legit_year_end_accrual",
    "threshold_adjacent": "legit_below_threshold",
    "missing_evidence": "legit_system_no_document",
}
VARIANTS = ["full", "no evidence uplift", "no evidence at all", "no model", "unranked"]
APPROACHES = ["rules", "statistics", "model", "statistics+model", "all"]


class TuningLedgerError(ValueError):
    """Asked to report on ledgers the thresholds were tuned on."""


def ratio(part, whole):
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Recall, precision and F1 from predicted, actual and hits; 0 where undefined."""
    scored = counts.withColumn("recall", ratio(F.col("hits"), F.col("actual"))).withColumn(
        "precision", ratio(F.col("hits"), F.col("predicted"))
    )
    both = F.col("recall") + F.col("precision")
    return scored.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), both))


def anomalous(truth: DataFrame, kind: str | None = None) -> DataFrame:
    test = F.size("anomalies") > 0 if kind is None else F.array_contains("anomalies", kind)
    return truth.where(test).select(*KEY)


def innocent(truth: DataFrame, kind: str | None = None) -> DataFrame:
    test = F.size("decoys") > 0 if kind is None else F.array_contains("decoys", kind)
    return truth.where(test).select(*KEY)


def score_sets(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Per ledger: how many were predicted, were there, and both."""
    tagged = (
        predicted.select(*KEY).distinct().withColumn("p", F.lit(1)).withColumn("a", F.lit(0))
        .unionByName(actual.select(*KEY).distinct().withColumn("p", F.lit(0)).withColumn("a", F.lit(1)))
    )
    per_voucher = tagged.groupBy(*KEY).agg(F.max("p").alias("p"), F.max("a").alias("a"))
    return with_scores(
        per_voucher.groupBy(LEDGER).agg(
            F.sum("p").alias("predicted"), F.sum("a").alias("actual"), F.sum(F.col("p") * F.col("a")).alias("hits")
        )
    )


def false_positive_rate(predicted: DataFrame, harmless: DataFrame) -> DataFrame:
    wrong = harmless.join(predicted.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    return wrong.groupBy(LEDGER).agg(ratio(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))).alias("rate"))


def found_marks(ranked_queue: DataFrame, interesting: DataFrame) -> DataFrame:
    """The queue with ``found``, 1 where it is interesting, else 0; one that carries it already is left as it is."""
    if "found" in ranked_queue.columns:
        return ranked_queue
    marks = interesting.select(*KEY).distinct().withColumn("found", F.lit(1))
    return ranked_queue.join(marks, KEY, "left").withColumn("found", F.coalesce("found", F.lit(0)))


def cumulative_hits(ranked_queue: DataFrame, interesting: DataFrame, by: Sequence[str] = (LEDGER,)) -> DataFrame:
    """Running true finds down each queue. Ranks are dense, so a queue is cut by rank range.

    ``by`` names the columns that tell queues apart: the ledger, or more.
    """
    marked = found_marks(ranked_queue, interesting).withColumn("_s", F.floor((F.col("rank") - 1) / HOT_ROWS))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy(*by, "_s").agg(F.sum("found").alias("_f")).withColumn(
        "_off", F.coalesce(F.sum("_f").over(before), F.lit(0))
    ).drop("_f")
    inside = Window.partitionBy(*by, "_s").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_run", F.sum("found").over(inside))
        .join(offsets, [*by, "_s"])
        .withColumn("found_so_far", F.col("_run") + F.col("_off"))
        .drop("_s", "_run", "_off")
    )


def precision_at(ranked_queue: DataFrame, interesting: DataFrame, budgets: list[int] | None = None) -> DataFrame:
    """Precision over the first k of each ledger's queue; fewer than k items count as they are."""
    marked = found_marks(ranked_queue, interesting)
    ks = F.explode(F.array(*map(F.lit, budgets or C.REVIEW_BUDGETS))).alias("k")
    top = marked.where(F.col("rank") <= max(budgets or C.REVIEW_BUDGETS)).select(LEDGER, "rank", "found", ks)
    return top.where(F.col("rank") <= F.col("k")).groupBy(LEDGER, "k").agg(F.avg("found").alias("precision"))


def queue_quality(ranked_queue: DataFrame, interesting: DataFrame, by: Sequence[str] = (LEDGER,)) -> DataFrame:
    """Per queue: size, precision at each budget, first find, items for 95 %, recall."""
    run = cumulative_hits(ranked_queue, interesting, by)
    wanted = interesting.select(*KEY).distinct().groupBy(LEDGER).agg(F.count(F.lit(1)).alias("interesting"))
    joined = run.join(wanted, LEDGER, "left")
    target = F.col("found_so_far") >= 0.95 * F.col("interesting")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, F.col("found"))), 3).alias(f"p_at_{k}")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queue"),
        *[at(k) for k in C.REVIEW_BUDGETS],
        F.min(F.when(F.col("found") == 1, F.col("rank"))).alias("first_hit"),
        F.min(F.when(target, F.col("rank"))).alias("items_for_95pct"),
        F.round(ratio(F.sum("found"), F.max("interesting")), 3).alias("recall"),
    )


def approach_sets(hits: DataFrame) -> DataFrame:
    """(approach, ledger, voucher) for rules, statistics, model and their unions."""
    layer = F.when(F.col("kind").isin(*C.RULE_KINDS), "rules").when(
        F.col("kind").isin(*C.STATISTIC_KINDS), "statistics"
    ).when(F.col("kind").isin(*C.MODEL_KINDS), "model")
    member = (
        F.when(layer == "rules", F.array(F.lit("rules"), F.lit("all")))
        .when(layer == "statistics", F.array(F.lit("statistics"), F.lit("statistics+model"), F.lit("all")))
        .when(layer == "model", F.array(F.lit("model"), F.lit("statistics+model"), F.lit("all")))
    )
    return hits.select(*KEY, F.explode(member).alias("approach")).distinct()


def approach_only(sets: DataFrame, one: str, other: str) -> DataFrame:
    pick = lambda name: sets.where(F.col("approach") == name).select(*KEY)
    return pick(one).join(pick(other), KEY, "left_anti")


def compare_approaches(sets: DataFrame, truth: DataFrame, totals: DataFrame) -> DataFrame:
    """Per ledger and approach: flagged, share of the ledger, recall, precision, decoys queued."""
    marks = truth.select(
        *KEY, (F.size("anomalies") > 0).cast("int").alias("a"), (F.size("decoys") > 0).cast("int").alias("d")
    )
    every = F.explode(F.array(*map(F.lit, APPROACHES))).alias("approach")
    per_ledger = marks.groupBy(LEDGER).agg(F.sum("a").alias("actual"))
    counted = sets.join(marks, KEY, "left").groupBy(LEDGER, "approach").agg(
        F.count(F.lit(1)).alias("flagged"), F.coalesce(F.sum("a"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("decoys_queued"),
    )
    full = totals.select(LEDGER, "n_vouchers", every).join(counted, [LEDGER, "approach"], "left").join(per_ledger, LEDGER)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(
        LEDGER, "approach", z("flagged").alias("flagged"),
        F.round(ratio(z("flagged"), F.col("n_vouchers")), 4).alias("queue_share"),
        F.round(ratio(z("hits"), z("actual")), 4).alias("recall"),
        F.round(ratio(z("hits"), z("flagged")), 4).alias("precision"),
        z("decoys_queued").alias("decoys_queued"),
    )


def side_by_side(sets: DataFrame, totals: DataFrame, benford: DataFrame) -> DataFrame:
    """Per ledger: flagged and share by layer, model-only vouchers, accounts off Benford."""
    per_voucher = sets.groupBy(*KEY).agg(
        *[F.max((F.col("approach") == a).cast("int")).alias(a) for a in ("rules", "statistics", "model", "all")]
    )
    counts = per_voucher.groupBy(LEDGER).agg(
        *[F.sum(a).alias(a + "_flagged") for a in ("rules", "statistics", "model", "all")],
        F.sum(F.col("model") * (1 - F.col("rules"))).alias("model_only"),
    )
    odd = benford.where(F.col("conformity") == "non-conforming").groupBy(LEDGER).agg(
        F.count(F.lit(1)).alias("non_conforming_accounts")
    )
    out = totals.select(LEDGER, "n_vouchers").join(counts, LEDGER, "left").join(odd, LEDGER, "left").na.fill(0)
    for a in ("rules", "statistics", "model", "all"):
        out = out.withColumn(a + "_share", F.round(ratio(F.col(a + "_flagged"), F.col("n_vouchers")), 4))
    return out


def signal_scorecard(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Per signal over ledgers: mean and minimum recall, summed trap false positives, weight."""
    spark = hits.sparkSession
    table = spark.createDataFrame(
        [(s, k, TRAPS.get(s), C.SIGNAL_WEIGHTS[s]) for s, k in RESPONSIBILITY.items()],
        "kind string, planted string, trap string, weight double",
    )
    marks = truth.select(
        *KEY,
        F.explode(F.concat(
            F.transform("anomalies", lambda x: F.struct(x.alias("label"), F.lit(False).alias("is_trap"))),
            F.transform("decoys", lambda x: F.struct(x.alias("label"), F.lit(True).alias("is_trap"))),
        )).alias("m"),
    ).select(*KEY, "m.*")
    duty = table.select("kind", F.explode(F.array(
        F.struct(F.col("planted").alias("label"), F.lit(False).alias("is_trap")),
        F.struct(F.col("trap").alias("label"), F.lit(True).alias("is_trap")),
    )).alias("d")).select("kind", "d.*").where(F.col("label").isNotNull())
    judged = marks.join(F.broadcast(duty), ["label", "is_trap"]).join(
        hits.select(*KEY, "kind").distinct().withColumn("hit", F.lit(1)), [*KEY, "kind"], "left"
    )
    rates = judged.groupBy(LEDGER, "kind", "is_trap").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("rate"))
    ledgers = truth.select(LEDGER).distinct()
    grid = ledgers.withColumn("kind", F.explode(F.array(*map(F.lit, RESPONSIBILITY))))
    recall = rates.where(~F.col("is_trap")).select(LEDGER, "kind", F.col("rate").alias("recall"))
    trap = rates.where("is_trap").select(LEDGER, "kind", F.col("rate").alias("trap_fp"))
    full = grid.join(recall, [LEDGER, "kind"], "left").join(trap, [LEDGER, "kind"], "left").na.fill(0.0)
    return (
        full.groupBy("kind").agg(
            F.round(F.avg("recall"), 4).alias("mean_recall"), F.round(F.min("recall"), 4).alias("min_recall"),
            F.round(F.sum("trap_fp"), 4).alias("trap_false_positives"),
        ).join(F.broadcast(table.select("kind", "weight")), "kind")
    )


def mean_by(frame: DataFrame, key: str) -> DataFrame:
    """Mean of every numeric column per key over ledgers, rounded to 4 places."""
    numeric = [f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    return frame.groupBy(key).agg(*[F.round(F.avg(c), 4).alias(c) for c in numeric])


def variant_queues(hits: DataFrame, context: DataFrame, interesting: DataFrame | None = None) -> DataFrame:
    """The ranked queue of every variant: ``variant``, the voucher, ``priority`` and ``rank``.

    The strongest hits of a voucher are found and met with its evidence once. A variant then only blanks
    what it leaves out, and one ranking keyed by ledger and variant orders all queues. With ``interesting``
    the queues carry ``found``, looked up once per voucher, not once per variant.
    """
    strong = strongest(hits).join(context.select(*KEY, F.col("completeness")), KEY)
    marked = [] if interesting is None else ["found"]
    if marked:
        strong = found_marks(strong, interesting)
    every = strong.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    variant = F.col("variant")
    unless = lambda column, *names: F.when(~variant.isin(*names), F.col(column))
    every = every.withColumns(
        {"completeness": unless("completeness", "no evidence uplift", "no evidence at all")}
        | {"w_missing_evidence": unless("w_missing_evidence", "no evidence at all")}
        | {"w_" + kind: unless("w_" + kind, "no model") for kind in C.MODEL_KINDS}
    )
    fused = fuse(every).where(F.col("priority") > 0).withColumn("priority", F.round("priority", 6))
    down = F.when(variant == "unranked", 0.0).otherwise(-F.col("priority"))
    kept = stage(fused.select(*KEY, "variant", "priority", *marked, down.alias("_down")), wide=True)
    return ranked(kept, [LEDGER, "variant"], ["_down", "voucher_id"], "rank").drop("_down")


def ablation(frames: LedgerFrames, interesting: DataFrame, *, use_model: bool = True) -> DataFrame:
    """Queue quality with one part switched off at a time, all variants in one pass."""
    hits = all_hits(frames, use_model=use_model, detail=False)
    context = frames.context(*EVERYTHING).select(*KEY, *evidence_columns())
    return queue_quality(variant_queues(hits, context, interesting), interesting, [LEDGER, "variant"])


def unranked(found: DataFrame) -> DataFrame:
    """The same findings in voucher order: what a reviewer faces without ranking."""
    return ranked(found, [LEDGER], ["voucher_id"], "rank")


def label_lift(truth: DataFrame, vouchers: DataFrame, pattern, kind: str) -> DataFrame:
    """Share of labelled vouchers showing a pattern over the share in the whole ledger."""
    marks = anomalous(truth, kind).withColumn("labelled", F.lit(1))
    joined = vouchers.join(marks, KEY, "left").withColumn("shows", F.coalesce(pattern.cast("int"), F.lit(0)))
    base, among = F.avg("shows"), F.avg(F.when(F.col("labelled") == 1, F.col("shows")))
    return joined.groupBy(LEDGER).agg(
        F.round(among, 6).alias("labelled_share"), F.round(base, 6).alias("baseline_share"),
        F.round(among / F.greatest(base, F.lit(1e-9)), 4).alias("lift"),
    )


def truth_summary(truth: DataFrame, totals: DataFrame) -> DataFrame:
    counts = truth.groupBy(LEDGER).agg(
        F.count_if(F.size("anomalies") > 0).alias("anomalous"), F.count_if(F.size("decoys") > 0).alias("decoys")
    )
    return counts.join(totals.select(LEDGER, "n_vouchers"), LEDGER).select(
        LEDGER, "anomalous", "decoys", F.round(ratio(F.col("anomalous"), F.col("n_vouchers")), 6).alias("anomaly_rate")
    )


def decoys_queued(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Legitimate look-alikes wrongly flagged, by their first kind."""
    kinds = truth.where(F.size("decoys") > 0).select(*KEY, F.element_at("decoys", 1).alias("decoy"))
    return found.select(*KEY).distinct().join(kinds, KEY).groupBy(LEDGER, "decoy").agg(F.count(F.lit(1)).alias("queued"))


def heldout_violations(ledgers: DataFrame, tuning: DataFrame) -> DataFrame:
    return ledgers.select(LEDGER).distinct().join(tuning.select(LEDGER).distinct(), LEDGER, "left_semi")


def require_heldout(ledgers: DataFrame, tuning: DataFrame) -> None:
    """Refuse to report on tuning ledgers (looks at one offending row, not at the data)."""
    bad = heldout_violations(ledgers, tuning).limit(1).collect()
    if bad:
        raise TuningLedgerError(f"ledger {bad[0][0]!r} was used while choosing the thresholds")

