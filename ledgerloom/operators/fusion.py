"""Hits and evidence to one ranked queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.config import KEY, LEDGER
from ledgerloom.functions import labels
from ledgerloom.operators.scale import ranked, stage

EVIDENCE_GAP = "evidence_gap"


def weights_table(spark: SparkSession) -> DataFrame:
    rows = [*C.SIGNAL_WEIGHTS.items(), (EVIDENCE_GAP, C.EVIDENCE_GAP_WEIGHT)]
    return spark.createDataFrame(rows, "kind string, weight double")


def contribution_order(weights: dict[str, float]) -> list[str]:
    """Rules by name, then statistics, then the model: the order ties are settled in."""
    late = [k for k in [*C.STATISTIC_KINDS, *C.MODEL_KINDS] if k in weights]
    return sorted(k for k in weights if k not in late) + late


def strongest(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per voucher one column ``w_<kind>`` with its strongest weighted hit.

    A plain max per kind, so the aggregate combines map-side and stays in generated code.
    """
    weights = weights or C.SIGNAL_WEIGHTS
    return hits.groupBy(*KEY).agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.col("strength") * weight)).alias("w_" + kind)
            for kind, weight in weights.items()
        ]
    )


def noisy_or(kinds: list[str]) -> Column:
    """1 - product of (1 - weighted strength), always multiplied in the same order."""
    survival = F.lit(1.0)
    for kind in kinds:
        survival = survival * (1.0 - F.least(F.coalesce(F.col("w_" + kind), F.lit(0.0)), F.lit(1.0)))
    return 1.0 - survival


def fuse(
    strongest_hits: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    completeness: str | None = "completeness",
) -> DataFrame:
    """Add base, priority and contributions. ``completeness=None`` leaves evidence out."""
    weights = weights or C.SIGNAL_WEIGHTS
    kinds = contribution_order(weights)
    alone = [k for k in kinds if k not in C.MODEL_KINDS]
    corroborated = F.coalesce(*[F.col("w_" + k) for k in alone]).isNotNull()
    base = F.when(corroborated, noisy_or(kinds)).otherwise(0.0)
    df = strongest_hits.withColumn("base", base)
    if completeness is None:
        uplift = F.lit(0.0)
    else:
        gap = 1.0 - F.coalesce(F.col(completeness), F.lit(1.0))
        uplift = F.when(corroborated, C.EVIDENCE_GAP_WEIGHT * gap * (1.0 - F.col("base"))).otherwise(0.0)
    df = df.withColumn("uplift", uplift)

    def share(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("contribution"))

    shares = [F.when(corroborated & F.col("w_" + k).isNotNull(), share(k, F.col("w_" + k))) for k in kinds]
    shares.append(F.when(F.col("uplift") > 0, share(EVIDENCE_GAP, F.round(F.round("uplift", 10), 4))))
    return (
        df.withColumn("priority", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + F.col("uplift"))))
        .withColumn("contributions", F.array_compact(F.array(*shares)))
        .drop(*["w_" + k for k in kinds])
    )


def by_strength(contributions: Column) -> Column:
    """Contributions strongest first; equal ones keep their order."""
    placed = F.transform(
        contributions,
        lambda x, i: F.struct((-x["contribution"]).alias("down"), i.alias("i"), x["kind"].alias("kind"), x["contribution"].alias("contribution")),
    )
    return F.transform(
        F.array_sort(placed), lambda x: F.struct(x["kind"].alias("kind"), x["contribution"].alias("contribution"))
    )


def headline_concerns(contributions: Column) -> Column:
    """Signal kinds strongest first without the minor ones, but never an empty list."""
    signals = F.array_sort(
        F.transform(
            F.filter(contributions, lambda x: x["kind"] != EVIDENCE_GAP),
            lambda x: F.struct((-x["contribution"]).alias("down"), x["kind"].alias("kind")),
        )
    )
    major = F.filter(signals, lambda x: -x["down"] >= C.MINOR_CONTRIBUTION)
    kept = F.when(F.size(major) > 0, major).otherwise(F.slice(signals, 1, 1))
    return F.transform(kept, lambda x: x["kind"])


def findings(hits: DataFrame, context: DataFrame, *, use_evidence: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per voucher worth a reviewer's time (unranked)."""
    from ledgerloom.operators.evidence import EVIDENCE_COLUMNS, evidence_columns

    facts = context.select(*KEY, "amount_paise", "voucher_date", "line_count", *evidence_columns())
    fused = fuse(
        strongest(hits, weights).join(facts, KEY),
        weights=weights,
        completeness="completeness" if use_evidence else None,
    ).where(F.col("priority") > 0)
    return fused.select(
        *KEY,
        F.round("priority", 6).alias("priority"),
        labels.risk_band(F.col("priority")).alias("band"),
        "amount_paise",
        "voucher_date",
        "line_count",
        F.array_sort(
            F.transform(F.filter("contributions", lambda x: x["kind"] != EVIDENCE_GAP), lambda x: x["kind"])
        ).alias("kinds"),
        "contributions",
        F.col("uplift").alias("evidence_uplift"),
        *EVIDENCE_COLUMNS,
    )


def top_concern(contributions: Column) -> Column:
    return F.try_element_at(by_strength(contributions), F.lit(1))["kind"]


def queue(found: DataFrame) -> DataFrame:
    """Rank findings inside their ledger: highest priority first, then voucher id."""
    kept = stage(found.withColumn("_down", -F.col("priority")), wide=True)
    return ranked(kept, [LEDGER], ["_down", "voucher_id"], "rank").drop("_down")


def by_total_strength(hits: DataFrame) -> DataFrame:
    """Flagged vouchers without fusion: by the sum of their strengths, ties by voucher."""
    total = hits.groupBy(*KEY).agg(F.round(F.sum("strength"), 6).alias("total"))
    return ranked(total.withColumn("_down", -F.col("total")), [LEDGER], ["_down", "voucher_id"], "rank").drop("_down")


def with_signals(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Attach the signals of each finding (at most one per kind), strongest first."""
    pair = found.select(*KEY, F.explode("contributions").alias("x")).select(*KEY, "x.kind", "x.contribution")
    own = hits.join(found.select(*KEY), KEY, "left_semi").join(pair, [*KEY, "kind"], "left")
    one = F.struct(
        (-F.coalesce(F.col("contribution"), F.lit(0.0))).alias("down"),
        F.col("kind"),
        F.col("strength"),
        F.col("reason"),
        F.coalesce(F.col("contribution"), F.lit(0.0)).alias("contribution"),
        F.col("evidence"),
    )
    signals = own.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("signals"))
    return found.join(signals, KEY)
